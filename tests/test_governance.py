"""Contracts, labels, upserts, lineage, storage and inventory on literal frames."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from lakeops.operators import classify as C
from lakeops.operators import diagnostics as D
from lakeops.operators import governance as G
from lakeops.operators import graph as L
from lakeops.operators import inventory as I
from lakeops.operators import profiles as P
from lakeops.operators import quality as Q
from lakeops.operators import sales as X
from lakeops.operators import storage as O
from lakeops.plans.catalog import QUERIES


# -- labels
def test_first_match_and_highest_priority(spark):
    df = spark.createDataFrame([(1, ["PERSONAL.EMAIL", "FINANCIAL.CREDIT_CARD_NUMBER"]), (2, []), (3, None), (4, ["INTERNAL_EMPLOYEE_ID"])],
                               "id int, classifications array<string>")
    first = {r.id: r.label for r in C.auto_label(df).collect()}
    top = {r.id: r.label for r in C.auto_label(df, mode="highest_priority").collect()}
    assert first == {1: "Confidential-PII", 2: "Internal", 3: "Internal", 4: "Confidential-PII"}
    assert top == {**first, 1: "Highly-Confidential-Restricted"}
    with pytest.raises(ValueError):
        C.auto_label(df, mode="other")


def test_label_rules_ignore_a_leading_vendor_segment(spark):
    df = spark.createDataFrame([(1, ["VENDOR.PERSONAL.EMAIL"]), (2, ["VENDOR.FINANCIAL.CREDIT_CARD_NUMBER", None]), (3, ["EMAIL"]), (4, [None])],
                               "id int, classifications array<string>")
    assert {r.id: r.label for r in C.auto_label(df).collect()} == {
        1: "Confidential-PII", 2: "Highly-Confidential-Restricted", 3: "Internal", 4: "Internal"}


def test_employee_ids_at_one_domain(spark, rows):
    df = spark.createDataFrame([("emp1@a.com", "emp1@b.com"), ("emp2@a.com", "emp2@axcom")], "own string, other string")
    assert rows(C.classify_columns("t", df, [C.employee_id_rule("a.com")]), "column_name", "match_ratio") == [("own", 1.0)]
    assert rows(C.classify_columns("t", df, [C.employee_id_rule()]), "column_name") == [("other",), ("own",)]


def test_classify_by_value_share_and_by_name(spark, rows):
    df = spark.createDataFrame([("LOY-123456789", 1), ("LOY-000000001", 2), ("no", 3), (None, 4)], "code string, base_pay int")
    assert rows(C.classify_columns("t", df), "column_name", "classification", "by_name") == [
        ("base_pay", "HR_COMPENSATION", True), ("code", "CUSTOMER_LOYALTY_ID", False)]


def test_column_sensitivity_takes_the_default(spark, rows):
    df = spark.createDataFrame([("t", None), ("t", "Public"), ("u", "Highly-Confidential-Restricted"), ("u", None), ("v", None)], "table_name string, sensitivity string")
    assert rows(C.column_sensitivity(df, {"t": "Internal", "u": "Public"}), "table_name", "sensitivity") == [
        ("t", "Internal"), ("u", "Highly-Confidential-Restricted")]


# -- contracts
def test_schema_drift(spark, rows):
    df = spark.createDataFrame([(1, None)], "id int, amount double")
    c = Q.Contract("t", (Q.ColumnRule("id", "bigint", nullable=False), Q.ColumnRule("amount", "double", nullable=False), Q.ColumnRule("gone", "string")))
    assert rows(Q.contract_schema_drift(df, c), "column_name", "kind") == [
        ("amount", "nullability drift"), ("gone", "missing column"), ("id", "type drift")]
    assert Q.contract_schema_drift(df, Q.Contract("t", (Q.ColumnRule("id", "int"),))).count() == 0


def test_schema_drift_sees_what_the_files_hold(spark, rows, tmp_path):
    spark.createDataFrame([(1, 5.0)], "o_orderkey bigint, o_totalprice double").withColumn(
        "o_orderdate", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    got = rows(QUERIES["contract_schema_drift"](spark, str(tmp_path)), "column_name", "kind")
    assert ("o_custkey", "missing column") in got and not [r for r in got if r[0] == "o_orderdate"]


def test_value_checks(spark):
    df = spark.createDataFrame([(1, 10, 5.0), (1, 11, -1.0), (2, None, None)], "id int, parent int, amount double")
    c = Q.Contract("t", (Q.ColumnRule("id", "int", nullable=False, pk=True), Q.ColumnRule("parent", "int", fk=("p", "k")),
                         Q.ColumnRule("amount", "double", nullable=False, range=(0, 10))), row_count_min=5, completeness_pct=90)
    got = {r.check_name: (r.violations, r.passed) for r in Q.contract_value_checks(df, c, {"p": spark.createDataFrame([(10,)], "k int")}).collect()}
    assert got == {"row_count_min": (2, False), "completeness:id": (0, True), "completeness:amount": (1, False), "range:amount": (1, False),
                   "unique:id": (1, False), "fk:parent": (1, False)}


def test_type_policy(spark, rows):
    df = spark.createDataFrame([("1", "2.50"), ("x", "1"), (None, "1"), ("2", None)], "id string, amount string")
    ok, bad = Q.apply_type_policy(df, {"id": "bigint", "amount": "decimal(18,2)"}, ["id"])
    assert dict(ok.dtypes) == {"id": "bigint", "amount": "decimal(18,2)"} and ok.count() == 2
    assert rows(bad, "id", "reasons") == [("x", "type:id"), (None, "null key:id")]


def test_profile(spark):
    df = spark.createDataFrame([("a" * 100, 1), ("a" * 100, 2), (None, 2)], "s string, n int")
    got = {r.column_name: r for r in P.column_profile("t", df).collect()}
    assert (got["s"].distinct_count, got["s"].null_count, got["s"].max_length) == (1, 1, 100)
    assert (got["n"].distinct_count, got["n"].min_value, got["n"].max_value) == (2, "1", "2")
    empty = P.column_profile("t", df.limit(0)).collect()
    assert [(r.row_count, r.distinct_count, r.null_pct) for r in empty] == [(0, 0, 0.0)] * 2


def test_unlimited_strings_are_oversized(spark, rows):
    cols = spark.createDataFrame([("t", "a", "varchar", -1, 0, 0, False), ("t", "b", "varchar", 4000, 0, 0, False), ("t", "c", "NVARCHAR", 4001, 0, 0, True)],
                                 "table_name string, column_name string, data_type string, max_length int, precision int, scale int, is_nullable boolean")
    assert rows(Q.schema_audit(cols, ["table_name"]), "column_name", "severity") == [("a", "High"), ("c", "High")]


def test_score_bands(spark):
    for passed, status in ((8, "healthy"), (7, "fair"), (6, "fair"), (5, "critical")):
        df = spark.createDataFrame([(i < passed,) for i in range(10)], "passed boolean")
        assert Q.health_control_score(df).first().status == status


def test_reconcile_sees_equal_counts_with_other_content(spark):
    a, b = (spark.createDataFrame(r, "k int, v double") for r in ([(1, 1.0), (None, 2.0)], [(1, 1.5), (None, 2.0)]))
    assert {r.k: r.matches for r in Q.reconcile_tables(a, b, ["k"], ["v"]).collect()} == {1: False, None: True}


def test_cde_names(spark, rows):
    el = spark.createDataFrame([("E", [("Shop.Customers", "CustomerID")])], "element string, columns array<struct<dataset: string, column_name: string>>")
    dic = spark.createDataFrame([("shop.customers", "customer_id", 0.0)], "table_name string, column_name string, null_pct double")
    assert rows(Q.cde_coverage(el, dic), "covered") == [(False,)]
    assert rows(Q.cde_coverage(el, dic, normalize_names=True), "covered") == [(True,)]


# -- upserts and budgets
def test_upsert_is_idempotent_and_null_safe(spark, rows):
    schema = "name string, parent string, note string"
    stored = spark.createDataFrame([("a", None, "x"), ("b", "a", None), ("old", None, "x")], schema)
    wanted = spark.createDataFrame([("a", None, "x"), ("b", "a", "new"), ("c", None, None)], schema)
    assert rows(G.upsert_diff(stored, wanted, ["name", "parent"], ["note"]), "name", "action") == [("a", "NOOP"), ("b", "UPDATE"), ("c", "CREATE")]
    after = G.merge_rows(stored, wanted, ["name", "parent"])
    assert after.count() == 4
    assert {r.action for r in G.upsert_diff(after, wanted, ["name", "parent"], ["note"]).collect()} == {"NOOP"}


def test_call_budget_levels(spark):
    t = dt.datetime(2024, 1, 1)
    calls = [(i, "t", t + dt.timedelta(seconds=i)) for i in range(10)] + [(10, None, t), (11, "t", None)]
    df = spark.createDataFrame(calls, "call_id int, tenant string, call_ts timestamp")
    got = [r.level for r in G.call_rate_window(df, limit=10, seconds=60).orderBy("call_id").collect()]
    assert got == ["ok"] * 7 + ["warn"] * 2 + ["stop"] + [None, None]


def test_first_theme_wins(spark, rows):
    df = spark.createDataFrame([("Online Sales",), ("HR Revenue",), ("Physics",), (None,)], "n string")
    assert rows(G.first_match_theme(df, "n"), "n", "theme") == [("HR Revenue", "finance"), ("Online Sales", "retail")]


# -- graphs
def test_closure_of_a_cycle(spark, rows):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "a"), (None, "a")], "src string, dst string")
    assert rows(L.lineage_closure(e), "node", "reached", "distance") == [
        ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "a", 2), ("b", "c", 1), ("b", "d", 2), ("c", "a", 1), ("c", "b", 2), ("c", "d", 1)]
    assert rows(L.lineage_closure(e, "upstream", max_distance=1).where("node = 'd'"), "reached") == [("c",)]


def test_closure_takes_the_shortest_way(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src int, dst int")
    assert {(r.node, r.reached): r.distance for r in L.lineage_closure(e).collect()}[(1, 4)] == 2


def test_closure_from_seeds_keeps_their_pairs_only(spark, rows):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,), ("nowhere",)], "node string")
    assert rows(L.lineage_closure(e, seeds=seeds), "node", "reached", "distance") == [("a", "b", 1), ("a", "c", 2)]
    assert rows(L.lineage_closure(e, "upstream", seeds=seeds), "node", "reached") == []


def test_registered_closure_starts_at_every_node(spark, rows, tmp_path):
    spark.range(9).selectExpr("id as c_custkey", "'' as c_name", "0 as c_nationkey", "0d as c_acctbal", "'' as c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    spark.sql("select 1L as o_orderkey, 8L as o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    # a node that no order names has its pairs as well
    want = [(k, k // 3, 1) for k in range(1, 9)] + [(k, k // 9, 2) for k in range(3, 9)]
    assert rows(QUERIES["lineage_closure"](spark, str(tmp_path)), "node", "reached", "distance") == sorted(want, key=lambda r: tuple(map(str, r)))


def test_closure_of_random_graphs_over_merged_levels(spark, monkeypatch, rows):
    import random

    rng = random.Random(2)
    monkeypatch.setattr(L, "LEVELS", 2)
    edges = [(k, k + 1) for k in range(9)] + [(9, 0)] + [(rng.randrange(14), rng.randrange(14)) for _ in range(8)]
    df = spark.createDataFrame(edges, "src int, dst int")
    nodes, want = range(14), {}
    for n in nodes:
        level, seen, d = {n}, {n}, 0
        while level:
            d += 1
            level = {b for a, b in edges if a in level} - seen
            seen |= level
            want.update({(n, m): d for m in level})
    got = L.lineage_closure(df)
    assert {(r.node, r.reached): r.distance for r in got.collect()} == want and got.count() == len(want)
    seeds = spark.createDataFrame([(3,), (12,), (99,)], "node int")
    got = L.lineage_closure(df, max_distance=3, seeds=seeds)
    assert {(r.node, r.reached): r.distance for r in got.collect()} == {p: d for p, d in want.items() if p[0] in (3, 12) and d <= 3}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lakeops_closure")]
    assert L.lineage_closure(df.limit(0)).count() == 0


def test_known_pairs_do_not_move(spark):
    df = spark.range(2000).selectExpr("id as node", "id + 1 as reached", "1 as distance")
    known, name, _, n = L._bucketed(df.repartition(4, "node", "reached"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = df.repartition(4, "node", "reached").dropDuplicates(["node", "reached"]).join(known.select("node", "reached"), ["node", "reached"], "left_anti")
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert n == 2000 and plan.count("Exchange") == 1 and new.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"drop table {name}")


def test_closure_sends_no_level_through_the_driver(spark, monkeypatch):
    plans, write = [], L._bucketed

    def spy(pairs, buckets):
        plans.append(pairs._jdf.queryExecution().executedPlan().toString())
        return write(pairs, buckets)

    monkeypatch.setattr(L, "_bucketed", spy)
    monkeypatch.setattr(L, "SMALL_LEVEL", 2, raising=False)
    e = spark.range(2, 41).selectExpr("id as src", "id div 2 as dst")
    got = L.lineage_closure(e)
    assert got.count() == sum(k.bit_length() - 1 for k in range(2, 41))
    # buckets are merged, not sent to the driver; only a level of at most two rows may be
    assert len(plans) == 6 and not any("Broadcast" in p for p in plans)


def test_glossary_orphans_and_cycles(spark, rows):
    t = spark.createDataFrame([("root", None), ("kid", "root"), ("lost", "nowhere"), ("x", "y"), ("y", "x")], "term string, parent_term string")
    assert rows(L.glossary_tree(t), "term", "level", "orphan") == [
        ("kid", 1, False), ("lost", None, True), ("root", 0, False), ("x", None, True), ("y", None, True)]


def test_domain_owners_are_inherited(spark, rows):
    d = spark.createDataFrame([(1, None, "A", None), (2, 1, "B", "bob"), (3, 2, "C", None)], "id int, parent_id int, name string, owners string")
    assert rows(L.domain_flatten(d, "owners", "desk"), "path", "depth", "owner") == [("A", 0, "desk"), ("A/B", 1, "bob"), ("A/B/C", 2, "bob")]


def test_related_terms_go_both_ways(spark, rows):
    t = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "zz")], "src string, dst string")
    terms = spark.createDataFrame([("a",), ("b",)], "term string")
    assert rows(L.related_terms(t, terms, "term")) == [("a", "b"), ("b", "a")]


def test_lineage_edges(spark, rows):
    p = spark.createDataFrame([("p", ["a", "b"], ["c"]), ("q", [], None)], "process string, inputs array<string>, outputs array<string>")
    assert rows(L.lineage_edges(p), "src", "dst") == [("a", "process:p"), ("b", "process:p"), ("process:p", "c")]


# -- storage
FILES = "item_type string, item_name string, file_path string, size_bytes long"


def test_directories(spark, rows):
    df = spark.createDataFrame([("L", "x", "f", 1), ("L", "x", "a/b/f", 10), ("L", "x", "a/b/c/d/f", 100), ("L", "x", "a/g", None)], FILES)
    assert rows(O.storage_by_directory(df, prefix_with_item=False), "directory", "bytes") == [
        ("/", 111), ("a", 110), ("a/b", 110), ("a/b/c", 100), ("a/b/c/d", 100)]
    assert rows(O.storage_by_directory(df, max_depth=3), "directory", "bytes") == [("/", 111), ("L", 111), ("L/x", 111), ("L/x/a", 110)]
    s = O.storage_summary(df).first()
    assert (s["items"], s.files, s.total_bytes, s.dirs_tracked) == (1, 4, 111, 7)
    assert O.storage_summary(df.limit(0)).first().files == 0


def test_either_deletion_flag(spark, rows):
    df = spark.createDataFrame([("L", "x", "a", 1, None, True, "2"), ("L", "x", "b", 1, True, None, "soon"), ("L", "x", "c", 1, False, None, "1"), ("L", "x", "d", None, True, False, None)],
                               FILES + ", is_deleted boolean, deleted boolean, remaining_days string")
    assert rows(O.soft_deleted_files(df), "file_path", "size_bytes", "deleted_time") == [("a", 1, "Unknown"), ("b", 1, "Unknown"), ("d", 0, "Unknown")]
    assert rows(O.expiring_files(df), "file_path", "remaining_days") == [("a", 2.0)]


# -- inventory
def test_complexity_and_wave(spark):
    items = spark.createDataFrame([(1, "n", 1, "Report"), (2, "n", 2, "Lakehouse"), (3, "n", 3, "Notebook"), (4, "n", 3, "Report"), (5, "n", 4, "NewThing"), (6, "n", None, "Report")],
                                  "item_id int, item_name string, workspace_id int, item_type string")
    ws = spark.createDataFrame([(i, f"w{i}", "c", "F2", "r") for i in range(1, 4)], "workspace_id int, workspace_name string, capacity_name string, sku string, region string")
    got = {r.workspace_id: (r.migration_complexity, r.suggested_wave, r.non_movable_types, r.workspace_name) for r in I.workspace_assessment(items, ws).collect()}
    assert got == {1: ("Low", 1, "", "w1"), 2: ("Medium", 2, "Lakehouse", "w2"), 3: ("High", 3, "Notebook", "w3"), 4: ("Medium", 2, "NewThing", None)}


def test_lock_names_need_an_object_lock(spark, rows):
    locks = spark.createDataFrame([("OBJECT", "X", "WAIT", 1, 7), ("OBJECT", "X", "WAIT", 1, 7), ("PAGE", "X", "GRANT", 1, 7)],
                                  "resource_type string, request_mode string, request_status string, session_id int, entity_id int")
    tables = spark.createDataFrame([(7, "t")], "entity_id int, table_name string")
    assert rows(D.lock_summary(locks, tables), "resource_type", "table_name", "lock_count") == [("OBJECT", "t", 2), ("PAGE", None, 1)]


def test_unknown_priority_comes_last(spark):
    recs = spark.createDataFrame([("a", "Odd"), ("b", "Info"), ("c", "Critical")], "area string, priority string")
    assert [r.area for r in D.prioritize_recommendations(recs).collect()] == ["c", "b", "a"]


def test_empty_maintenance_object_counts_as_none(spark, rows):
    cfg = "config struct<enabled: boolean, vOrderOptimization: struct<enabled: boolean>, unreferencedFileRetention: struct<enabled: boolean, retentionPeriod: string>, fileCompaction: struct<enabled: boolean>>"
    df = spark.createDataFrame([(1, "a", "Lakehouse", (None, None, None, None)), (2, "b", "Lakehouse", (True, (True,), (True, None), None)), (3, "c", "Warehouse", None)],
                               "item_id int, item_name string, item_type string, " + cfg)
    assert rows(D.maintenance_flags(df), "item_id", "maintenance_enabled", "retention_period_days", "vorder_enabled", "compaction_enabled") == [
        (1, "OFF", None, "Unknown", "Unknown"), (2, "ON", 7, "ON", "OFF"), (3, "ON (Auto)", None, "ON (Auto)", "ON (Auto)")]


# -- sales
def test_zero_quota_and_quota_without_sales(spark, rows):
    sales = spark.createDataFrame([(1, 1, "2024Q1", 5.0), (2, 9, "2024Q1", 5.0)], "sale_id int, rep_id int, quarter string, amount double")
    quota = spark.createDataFrame([(1, "2024Q1", 0), (2, "2024Q1", 10)], "rep_id int, quarter string, quota_amount int")
    reps = spark.createDataFrame([(1, "r1", "NA", "SMB")], "rep_id int, full_name string, region string, segment string")
    out = X.fact_rep_performance({"fact_sales": sales, "fact_quota": quota, "sales_reps": reps})
    assert rows(out, "rep_id", "actual", "attainment_pct", "full_name") == [(1, 5.0, None, "r1"), (2, 0.0, 0.0, None)]


def test_gold_registry(spark):
    assert {"dim_account", "dim_sales_rep", "fact_pipeline_by_stage", "fact_revenue_by_quarter", "fact_rep_performance", "fact_account_pipeline", "fact_lead_funnel"} <= X.GOLD.keys()
    X.register_gold("extra")(lambda silver, **_: silver["t"].select(F.lit(1).alias("x")))
    try:
        assert X.GOLD["extra"]({"t": spark.range(2)}).count() == 2
    finally:
        del X.GOLD["extra"]


def test_repeated_keys_do_not_multiply_rows(spark, rows):
    from lakeops.operators import governance as G
    stored = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    wanted = spark.createDataFrame([("a", 1), ("b", 5), ("b", 7)], "k string, v int")
    assert rows(G.upsert_diff(stored, wanted.where("k = 'a'"), ["k"], ["v"])) == [("a", 1, "NOOP")]
    assert rows(G.merge_rows(stored.limit(1), wanted, ["k"])) == [("a", 1), ("b", 7)]


def test_profile_compares_typed_values(spark):
    from lakeops.operators import quality
    df = spark.createDataFrame([(0.0, "x" * 80), (-0.0, "x" * 80), (1.0, None)], "v double, t string")
    got = {r.column_name: r.distinct_count for r in P.column_profile("t", df).collect()}
    assert got == {"v": 2, "t": 1}


def test_deep_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    cut = L.cut_lineage_counted
    monkeypatch.setattr(L, "cut_lineage_counted", lambda *a: rounds.append(1) or cut(*a))
    chain = spark.range(1000).selectExpr("id", "nullif(id - 1, -1) as parent_id", "cast(id as string) as name", "if(id % 300 = 7, concat('o', id), null) as owner")
    got = {r.id: r for r in L.domain_flatten(chain, "owner", "none").collect()}
    assert len(rounds) <= 12
    for k in (0, 1, 6, 7, 8, 511, 512, 999):
        owners = [j for j in range(7, k + 1, 300)]
        assert got[k].depth == k and got[k].path == "/".join(map(str, range(k + 1))) and got[k].owner == (f"o{owners[-1]}" if owners else "none")
    assert len(got) == 1000


def test_random_forests_with_cycles_and_gaps(spark):
    import random

    rng = random.Random(5)
    for n in (1, 40, 90):
        parent = {k: rng.choice([None, n + 5, *([rng.randrange(n)] * 6)]) for k in range(n)}
        name = {k: rng.choice([None, f"n{k}"]) for k in parent}
        want = set()
        for k in parent:
            chain, at = [k], parent[k]
            while at is not None and at in parent and at not in chain:
                chain.append(at)
                at = parent[at]
            if at is None:
                want.add((k, len(chain) - 1, "/".join(name[c] for c in reversed(chain) if name[c])))
        df = spark.createDataFrame([(k, parent[k], name[k]) for k in parent], "id int, parent_id int, name string")
        assert {(r.id, r.depth, r.path) for r in L.domain_flatten(df).collect()} == want
        terms = {(r.term, r.level, r.orphan) for r in L.glossary_tree(df.selectExpr("id as term", "parent_id as parent_term")).collect()}
        level = {k: d for k, d, _ in want}
        assert terms == {(k, level.get(k), k not in level) for k in parent}
