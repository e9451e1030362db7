"""Classification, labels, environments, upserts, budgets, lineage and trees."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.functions import constants as K
from lakeops.functions import scalars as S
from lakeops.operators import classify as C
from lakeops.operators import governance as G
from lakeops.operators import graph as L
from lakeops.operators import quality as Q
from lakeops.plans.lake import SCHEMAS
from lakeops.plans.registry import query
from lakeops.session import scratch_path, small_frame

# -- classification ------------------------------------------------------------------

#: the loyalty pattern reads customer names, the e-mail rule reads texts
RULES = (
    C.ClassificationRule("CUSTOMER_LOYALTY_ID", r"^Customer#[0-9]{9}$", r"(?i)loyalty.*id", 0.6, "Customer#"),
    C.ClassificationRule("PERSONAL.EMAIL", C.PII_PATTERNS["email"], None, 0.005, "@"),
    C.ClassificationRule("HR_COMPENSATION", None, r"(?i)(salary|compensation|acctbal)", 0.8),
)
CLASSIFY = f"""
ratios as (
 select 'customer' as table_name, 'c_name' as column_name, 'CUSTOMER_LOYALTY_ID' as classification,
  (count(*) filter (regexp_matches(c_name, '^Customer#[0-9]{{9}}$')))::double / count(c_name)::double as match_ratio, false as by_name, 0.6 as lim from customer
 union all select 'customer', 'c_mktsegment', 'CUSTOMER_LOYALTY_ID', (count(*) filter (regexp_matches(c_mktsegment, '^Customer#[0-9]{{9}}$')))::double / count(*)::double, false, 0.6 from customer
 union all select 'customer', 'c_acctbal', 'HR_COMPENSATION', 0.0, true, 0.8
 union all select 'documents', 'text', 'PERSONAL.EMAIL', (count(*) filter (regexp_matches(text, '{C.PII_PATTERNS['email']}')))::double / count(text)::double, false, 0.005 from documents
 union all select 'supplier', 's_acctbal', 'HR_COMPENSATION', 0.0, true, 0.8),
classified as (select table_name, column_name, classification, match_ratio, by_name from ratios where match_ratio >= lim or by_name)"""


def _classified(lake):
    parts = [C.classify_columns(t, lake.table(t), RULES) for t in ("customer", "documents", "supplier")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _all_ratios() -> str:
    """Every rule on every column of every table, as SQL."""
    parts = []
    for t, ddl in SCHEMAS.items():
        for c, kind in (d.split(" ", 1) for d in ddl.split(", ")):
            for r in RULES:
                by_name = bool(r.column_pattern and re.search(r.column_pattern, c))
                if r.value_pattern and kind == "string":
                    ratio = f"coalesce((count(*) filter (regexp_matches({c}, '{r.value_pattern}')))::double / nullif(count({c}), 0)::double, 0.0)"
                    parts.append(f"select '{t}' as table_name, '{c}' as column_name, '{r.name}' as classification, {ratio} as match_ratio, {by_name} as by_name, {r.min_match} as lim from {t}")
                elif by_name:
                    parts.append(f"select '{t}', '{c}', '{r.name}', 0.0, true, {r.min_match}")
    return " union all ".join(parts)


@query("classify_columns", f"""
with ratios as ({_all_ratios()})
select table_name, column_name, classification, match_ratio, by_name from ratios where match_ratio >= lim or by_name""")
def _(lake):
    return reduce(DataFrame.unionByName, [C.classify_columns(t, lake.table(t), RULES) for t in SCHEMAS])


@query("pii_scan", f"""
select 'documents' as table_name, source as part, count(*) as rows, {', '.join(f"count(*) filter (regexp_matches(text, '{p}')) as {k}_rows" for k, p in C.PII_PATTERNS.items())}
from documents group by source
union all select 'conversations', role, count(*), {', '.join(f"count(*) filter (regexp_matches(text, '{p}'))" for p in C.PII_PATTERNS.values())}
from conversations group by role
union all select 'pages', 'html', count(*), {', '.join(f"count(*) filter (regexp_matches(html, '{p}'))" for p in C.PII_PATTERNS.values())}
from pages having count(*) > 0""")
def _(lake):
    docs = C.pii_scan(lake.table("documents").withColumnRenamed("source", "part"), "text", ["part"])
    talks = C.pii_scan(lake.table("conversations").withColumnRenamed("role", "part"), "text", ["part"])
    pages = C.pii_scan(lake.table("pages").withColumn("part", F.lit("html")), "html", ["part"])
    return docs.withColumn("table_name", F.lit("documents")).unionByName(
        talks.withColumn("table_name", F.lit("conversations"))).unionByName(pages.withColumn("table_name", F.lit("pages")))


#: assets: one per document, classified by what it holds
HAS = {"PERSONAL.EMAIL": C.PII_PATTERNS["email"], "FINANCIAL.CREDIT_CARD_NUMBER": C.PII_PATTERNS["card"]}
_email, _card = (f"regexp_matches(text, '{p}')" for p in HAS.values())
LABELS = f"""
assets as (select doc_id, source, {_email} as email, {_card} or doc_id % 17 = 0 as card, doc_id % 23 = 0 as employee from documents),
labelled as (select doc_id, source,
 case when email then 'Confidential-PII' when card then 'Highly-Confidential-Restricted' when employee then 'Confidential-PII' else 'Internal' end as label,
 case when card then 'Highly-Confidential-Restricted' when email or employee then 'Confidential-PII' else 'Internal' end as highest from assets)"""


def _assets(lake):
    email, card = C.matches("text", C.PII_PATTERNS["email"], "@"), C.matches("text", C.PII_PATTERNS["card"])
    found = F.filter(F.array(
        F.when(email, F.lit("PERSONAL.EMAIL")),
        F.when(card | (F.col("doc_id") % 17 == 0), F.lit("FINANCIAL.CREDIT_CARD_NUMBER")),
        F.when(F.col("doc_id") % 23 == 0, F.lit("INTERNAL_EMPLOYEE_ID"))), lambda c: c.isNotNull())
    # the scan result is a table of its own: labelling it must not read the texts again
    path = scratch_path(lake.spark, "classified")
    lake.table("documents").select("doc_id", "source", found.alias("classifications")).write.parquet(path)
    return lake.spark.read.schema("doc_id bigint, source string, classifications array<string>").parquet(path)


def _labelled(lake):
    return C.auto_label(_assets(lake)).drop("classifications")


@query("auto_label", f"with {LABELS} select * from labelled")
def _(lake):
    first = C.auto_label(_assets(lake))
    return C.auto_label(first.withColumnRenamed("label", "first"), mode="highest_priority").select(
        "doc_id", "source", F.col("first").alias("label"), F.col("label").alias("highest"))


@query("label_distribution", f"with {LABELS} select label, count(*) as assets from labelled group by label")
def _(lake):
    return C.label_distribution(_labelled(lake))


PRIORITY = "cast(case {} when 'Public' then 0 when 'Internal' then 1 when 'Confidential-PII' then 2 when 'Highly-Confidential-Restricted' then 3 end as int)"


@query("column_sensitivity", f"""
with {LABELS},
cols as (select source as table_name, case when label <> 'Internal' then label when source = 'src0' then 'Internal' else 'Public' end as sensitivity from labelled),
ranked as (select *, {PRIORITY.format('sensitivity')} as p from cols)
select table_name, count(*) as columns, arg_max(sensitivity, p) as sensitivity, max(p) as priority from ranked group by table_name""")
def _(lake):
    own = F.nullif(F.col("label"), F.lit("Internal"))
    cols = _labelled(lake).select(F.col("source").alias("table_name"), own.alias("sensitivity"))
    known = S.lookup("table_name", {"src0": "Internal"}, "Public")
    return C.column_sensitivity(cols.withColumn("sensitivity", F.coalesce("sensitivity", known)), {"src0": "Internal"})


@query("dlp_gap", f"with {LABELS} select doc_id, source, label from labelled where label = 'Highly-Confidential-Restricted'")
def _(lake):
    policies = small_frame(lake.spark, [("Confidential-PII",)], "label string")
    return C.dlp_gap(_labelled(lake), policies).select("doc_id", "source", "label")


@query("integrity_checks", f"""
with {CLASSIFY},
labels_of as (select table_name, column_name, bool_or(classification = 'HR_COMPENSATION') as restricted,
 case when bool_or(classification in ('CUSTOMER_LOYALTY_ID', 'PERSONAL.EMAIL', 'PERSONAL.PHONE_NUMBER', 'GOVERNMENT.US.SOCIAL_SECURITY_NUMBER')) then 'Confidential-PII'
  when bool_or(classification in ('FINANCIAL.CREDIT_CARD_NUMBER', 'HR_COMPENSATION')) then 'Highly-Confidential-Restricted'
  when bool_or(classification = 'INTERNAL_EMPLOYEE_ID') then 'Confidential-PII' else 'Internal' end as label
 from classified group by table_name, column_name),
checks(check_name, measure) as (
 select 'customers row count > 0', count(*)::double from customer
 union all select 'orders.customer_id integrity pct', (count(*) filter (o_custkey in (select c_custkey from customer)))::double / count(*)::double * 100 from orders
 union all select 'pii columns classified pct', count(distinct column_name)::double / 3.0::double * 100 from classified where column_name in ('c_name', 'text', 'html')
 union all select 'restricted columns labelled pct', case when count(*) = 0 then 100.0::double
  else (count(*) filter (label = 'Highly-Confidential-Restricted'))::double / count(*)::double * 100 end from labels_of where restricted)
select *, case when check_name like '%> 0' then measure > 0 else measure >= 100 end as passed from checks""")
def _(lake):
    orders = lake.table("orders").select(F.col("o_custkey").alias("customer_id"))
    customers = lake.table("customer").select(F.col("c_custkey").alias("customer_id"))
    classified = _classified(lake)
    labelled = C.auto_label(C.by_column(classified)).withColumn("is_restricted", F.array_contains("classifications", "HR_COMPENSATION"))
    return Q.integrity_checks(orders, customers, classified, labelled, ["c_name", "text", "html"], "Highly-Confidential-Restricted")


# -- environments and rules -------------------------------------------------------------

ENVS = [("dev", False), ("test", False), ("prod", True)]
ENV_SQL = """
envs(env, is_prod) as (values ('dev', false), ('test', false), ('prod', true)),
placed as (select c.*, env, is_prod, case when is_prod then capacity_name else concat(capacity_name, '-', env) end as env_name from fx_capacities c cross join envs)"""


@query("replicate_by_env", f"with {ENV_SQL} select * from placed")
def _(lake):
    return G.replicate_by_env(lake.fx("capacities"), "capacity_name", ENVS)


@query("env_domain_name", f"with {ENV_SQL} select capacity_id, env, env_name, capacity_name as base_name from placed")
def _(lake):
    return G.replicate_by_env(lake.fx("capacities"), "capacity_name", ENVS).select(
        "capacity_id", "env", "env_name", S.env_base_name("env_name", "env", "is_prod").alias("base_name"))


@query("env_find_replace", "select doc_id, replace(replace(text, 'the', '$workspace.id'), '$workspace', 'de-prod') as text from documents")
def _(lake):
    rules = [("the", "$workspace.id"), ("$workspace", "de-prod")]
    return lake.table("documents").select("doc_id", S.env_find_replace("text", rules).alias("text"))


THEMES = [("blue ring", "jewels"), ("ring", "circles"), ("widget", "parts"), ("green", "garden")]


@query("first_match_theme", f"""
select item_id, item_name, theme from (select *, case {' '.join(f"when contains(lower(item_name), '{p}') then '{t}'" for p, t in THEMES)} end as theme from fx_items)
where theme is not null""")
def _(lake):
    return G.first_match_theme(lake.fx("items"), "item_name", THEMES).select("item_id", "item_name", "theme")


@query("exclude_substrings", "select item_id, item_name from fx_items where not contains(lower(item_name), 'ring') and not contains(lower(item_name), 'small')")
def _(lake):
    return G.exclude_substrings(lake.fx("items"), "item_name", ["Ring", "SMALL"]).select("item_id", "item_name")


@query("normalize_data_type", """
select item_id, item_type, case lower(item_type) when 'report' then 'Text' when 'notebook' then 'Number' when 'lakehouse' then 'DateTime'
 when 'warehouse' then 'Boolean' else item_type end as canonical, 'Number' as of_int from fx_items""")
def _(lake):
    alias = {"report": "Text", "notebook": "Number", "lakehouse": "DateTime", "warehouse": "Boolean"}
    return lake.fx("items").select("item_id", "item_type", S.normalize_data_type("item_type", alias).alias("canonical"),
                                   S.normalize_data_type(F.lit(" INT ")).alias("of_int"))


# -- upserts ----------------------------------------------------------------------------

#: stored: all but every fifth account, every third renamed; parent NULL for every fourth
STORED = """
desired as (select account_id, nullif(account_id % 4, 0) as parent, account_name as name, industry from fx_accounts),
stored as (select account_id, nullif(account_id % 4, 0) as parent, case when account_id % 3 = 0 then concat(account_name, '?') else account_name end as name, industry
 from fx_accounts where account_id % 5 <> 0)"""
ACTION = "case when account_id % 5 = 0 then 'CREATE' when account_id % 3 = 0 then 'UPDATE' else 'NOOP' end"


def accounts_pair(lake):
    a = lake.fx("accounts").select("account_id", F.nullif(F.col("account_id") % 4, F.lit(0)).cast("double").alias("parent"),
                                   F.col("account_name").alias("name"), "industry")
    stored = a.where(F.col("account_id") % 5 != 0).withColumn(
        "name", F.when(F.col("account_id") % 3 == 0, F.concat("name", F.lit("?"))).otherwise(F.col("name")))
    return stored, a


@query("upsert_diff", f"with {STORED} select account_id, cast(parent as double) as parent, name, industry, {ACTION} as action from desired")
def _(lake):
    stored, desired = accounts_pair(lake)
    return G.upsert_diff(stored, desired, ["account_id", "parent"], ["name", "industry"])


@query("not_in_existing", f"with {STORED} select account_id, name from desired where account_id not in (select account_id from stored)")
def _(lake):
    stored, desired = accounts_pair(lake)
    return G.not_in_existing(desired, stored, "account_id").select("account_id", "name")


@query("call_rate_window", """
with counted as (select *, count(*) over (partition by tenant order by call_ts range between interval 1 hour preceding and current row) as calls_in_window from fx_api_calls)
select call_id, tenant, http_status, calls_in_window, case when calls_in_window / 10.0::double >= 0.95 then 'stop' when calls_in_window / 10.0::double >= 0.8 then 'warn' else 'ok' end as level
from counted""")
def _(lake):
    return G.call_rate_window(lake.fx("api_calls"), limit=10, seconds=3600).drop("call_ts")


# -- lineage ----------------------------------------------------------------------------

EDGES = """
proc as (select o_orderkey as process, 'customer:' || o_custkey as input, 'supplier:' || (o_orderkey % (select count(*) from supplier)) as output from orders),
edges as (select input as src, 'process:' || process as dst, 'input' as kind from proc union all select 'process:' || process, output, 'output' from proc)"""


@query("lineage_edges", f"with {EDGES} select * from edges")
def _(lake):
    n = lake.table("supplier").agg(F.count(F.lit(1))).scalar()
    processes = lake.table("orders").select(
        F.col("o_orderkey").alias("process"), F.array(F.concat(F.lit("customer:"), "o_custkey")).alias("inputs"),
        F.array(F.concat(F.lit("supplier:"), F.col("o_orderkey") % n)).alias("outputs"))
    return L.lineage_edges(processes)


#: manager edges; the root reports to itself in the closure input, which must not loop
TREE = """
recursive up(node, reached, distance) as (
 select employee_id, manager_id, 1 from fx_employees where manager_id is not null and employee_id <> manager_id
 union all select u.node, e.manager_id, u.distance + 1 from up u join fx_employees e on u.reached = e.employee_id
 where e.manager_id is not null and e.manager_id <> e.employee_id)"""


def _edges(lake):
    return lake.fx("employees").select(F.col("employee_id").alias("src"), F.col("manager_id").alias("dst"))


@query("lineage_closure", f"with {TREE} select node, reached, cast(distance as int) as distance from up")
def _(lake):
    # upward from every node: all pairs of a tree are its nodes times their depth
    return L.lineage_closure(_edges(lake))


@query("lineage_within", f"""
with {TREE} select reached as node, node as reached, cast(distance as int) as distance from up
where distance <= 3 and reached in (select s_suppkey from supplier)""")
def _(lake):
    # downward at most three levels from the nodes that a given table names
    return L.lineage_closure(_edges(lake), "upstream", max_distance=3, seeds=lake.table("supplier").select(F.col("s_suppkey").alias("node")))


@query("assets_without_lineage", "select employee_id, department from fx_employees where employee_id not in (select manager_id from fx_employees where manager_id is not null)")
def _(lake):
    return L.assets_without_lineage(lake.fx("employees"), _edges(lake), "employee_id").select("employee_id", "department")


@query("org_chain", """
select e.employee_id, cast(e.manager_id as double) as manager_id, e.department, e.salary_usd, m.department as manager_department, m.salary_usd as manager_salary_usd
from fx_employees e left join fx_employees m on e.manager_id = m.employee_id""")
def _(lake):
    return L.org_chain(lake.fx("employees")).withColumn("manager_id", F.col("manager_id").cast("double"))


@query("related_terms", """
with known as (select employee_id from fx_employees where employee_id < (select count(*) from customer) * 2 / 3),
pairs as (select distinct employee_id as a, manager_id as b from fx_employees where employee_id in (from known) and manager_id in (from known))
select a as term, b as related from pairs union select b, a from pairs""")
def _(lake):
    n = lake.table("customer").agg(F.count(F.lit(1))).scalar()
    return L.related_terms(_edges(lake), lake.fx("employees").where(F.col("employee_id") < n * 2 / 3), "employee_id")


@query("orphan_edges", """
with known as (select employee_id from fx_employees where employee_id < (select count(*) from customer) * 2 / 3)
select employee_id as node, 'subject' as role, count(*) as edges from fx_employees where employee_id not in (from known) group by 1
union all select manager_id, 'object', count(*) from fx_employees where manager_id is not null and manager_id not in (from known) group by 1""")
def _(lake):
    n = lake.table("customer").agg(F.count(F.lit(1))).scalar()
    return L.orphan_edges(_edges(lake), lake.fx("employees").where(F.col("employee_id") < n * 2 / 3), "employee_id")


#: every 50th employee's manager does not exist, so their branch is orphaned
TERMS = "terms as (select employee_id as term, case when employee_id % 50 = 49 then -1 else manager_id end as parent_term, department from fx_employees)"
LEVELS = f"""
recursive {TERMS},
tree(term, parent, level, path, owner) as (
 select term, parent_term, 0, cast(term as varchar), case when term % 10 = 0 then department else 'steward' end from terms where parent_term is null
 union all select t.term, t.parent_term, tree.level + 1, tree.path || '/' || t.term, case when t.term % 10 = 0 then t.department else tree.owner end
 from terms t join tree on t.parent_term = tree.term)"""


def _terms(lake):
    return lake.fx("employees").select(
        F.col("employee_id").alias("term"), F.when(F.col("employee_id") % 50 == 49, F.lit(-1)).otherwise(F.col("manager_id")).alias("parent_term"),
        "department")


@query("glossary_tree", f"""
with {LEVELS}
select t.term, cast(t.parent_term as double) as parent_term, department, cast(level as double) as level, level is null as orphan
from terms t left join tree on t.term = tree.term""")
def _(lake):
    out = L.glossary_tree(_terms(lake))
    return out.withColumns({"parent_term": F.col("parent_term").cast("double"), "level": F.col("level").cast("double")})


@query("domain_flatten", f"""
with {LEVELS} select term as id, cast(parent as double) as parent, cast(term as varchar) as name, cast(level as int) as depth, path, owner from tree""")
def _(lake):
    domains = _terms(lake).select(F.col("term").alias("id"), F.col("parent_term").alias("parent_id"), F.col("term").alias("name"),
                                  F.when(F.col("term") % 10 == 0, F.col("department")).alias("owners"))
    return L.domain_flatten(domains, "owners", "steward").withColumn("parent", F.col("parent").cast("double"))
