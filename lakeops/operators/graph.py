"""Lineage edges, closures, trees and term links.

Iterative operators write each round to the shared folder, so a lost executor
costs one round at most and a plan holds one leaf per round. Trees double their
pointers (log2(depth) rounds); closures join the newest level with the edges:
broadcast while that level has few rows, else a shuffle whose hot nodes adaptive
execution splits.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lakeops.session import cut_lineage, cut_lineage_counted, scratch_path


def lineage_edges(processes: DataFrame) -> DataFrame:
    """``process, inputs[], outputs[]`` → ``src, dst, kind``: dataset to process and process to dataset."""
    node = F.concat(F.lit("process:"), F.col("process").cast("string"))
    reads = processes.select(F.explode("inputs").alias("src"), node.alias("dst"), F.lit("input").alias("kind"))
    writes = processes.select(node.alias("src"), F.explode("outputs").alias("dst"), F.lit("output").alias("kind"))
    return reads.unionByName(writes)


#: Written levels that a round of the closure looks through before they are merged into one.
LEVELS = 6
#: Rows of a level that may be broadcast; what the driver gets of a round does not grow with the graph.
SMALL_LEVEL = 16_384
_PAIR = ("node", "reached")


def _bucketed(pairs: DataFrame, buckets: int) -> tuple[DataFrame, str, str, int]:
    """Pairs written in buckets of (node, reached): (as a bucketed table, its name, its path, its rows)."""
    spark, seen = pairs.sparkSession, Observation()
    name, path = f"lakeops_closure_{uuid.uuid4().hex}", scratch_path(pairs.sparkSession, "closure")
    pairs.observe(seen, F.count(F.lit(1)).alias("n")).write.format("parquet").bucketBy(buckets, *_PAIR).sortBy(*_PAIR).option("path", path).saveAsTable(name)
    return spark.table(name), name, path, seen.get["n"]


def lineage_closure(edges: DataFrame, direction: str = "downstream", max_distance: int | None = None,
                    seeds: DataFrame | None = None) -> DataFrame:
    """Every ``node, reached`` pair with its shortest ``distance``; cycles end because a known pair is not taken again.

    ``edges`` has ``src`` and ``dst``. Unbounded unless ``max_distance`` is given. With ``seeds`` (a column ``node``,
    repeats and NULLs allowed) only pairs that start there are followed, so the result grows with what they reach;
    without them it is all pairs, which suits small or shallow graphs only.

    Pairs of every level are kept in as many buckets as a shuffle has partitions. A round deals its new pairs into the
    same buckets once; removing repeats and known pairs then needs no further shuffle, and what is known never moves,
    nor to the driver: buckets are merged, whatever their size. Only a level of up to ``SMALL_LEVEL`` rows is broadcast.
    Every ``LEVELS`` rounds the levels become one table.
    """
    a, b = ("src", "dst") if direction == "downstream" else ("dst", "src")
    spark = edges.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = cut_lineage(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.col(a).alias("_from"), F.col(b).alias("_to")).distinct())
    first = step.where(F.col("_from") != F.col("_to")).select(
        F.col("_from").alias("node"), F.col("_to").alias("reached"), F.lit(1).alias("distance"))
    if seeds is not None:
        first = first.join(seeds.select("node"), "node", "left_semi")
    schema, names, paths, levels, distance = first.schema, [], [], [], 1
    new = first.repartition(buckets, *_PAIR)
    try:
        while True:
            frontier, name, path, rows = _bucketed(new, buckets)
            names.append(name)
            if rows or not paths:
                paths.append(path)
                levels.append(frontier)
            if not rows or distance == max_distance:
                break
            distance += 1
            if len(levels) > LEVELS:
                # the newest level stays apart, the others become one
                merged, name, _, _ = _bucketed(reduce(DataFrame.unionByName, levels[:-1]).repartition(buckets, *_PAIR), buckets)
                names.append(name)
                levels = [merged, levels[-1]]
            near = F.broadcast(frontier) if rows <= SMALL_LEVEL else frontier.hint("merge")
            new = near.join(step, near["reached"] == step["_from"]).select(
                "node", F.col("_to").alias("reached")).where(F.col("node") != F.col("reached")).repartition(buckets, *_PAIR).dropDuplicates(_PAIR)
            for known in levels:
                new = new.join(known.select(*_PAIR).hint("merge"), list(_PAIR), "left_anti")
            new = new.select(*_PAIR, F.lit(distance).alias("distance"))
    finally:
        for name in names:  # the files stay for the result, the names go
            spark.sql(f"drop table if exists {name}")
    return spark.read.schema(schema).parquet(*paths)


def walk_tree(nodes: DataFrame, node_id: str, parent_id: str, label: str, inherit: str | None = None,
              default: str = "", paths: bool = True) -> DataFrame:
    """Nodes reachable from a root: ``id, parent, name, depth, path, inherited``.

    A root has no parent. ``path`` joins the names from the root down (a missing name is left out). ``inherit`` names a
    column a node takes from its nearest ancestor where its own value is missing, the root from ``default``. Nodes
    whose chain never reaches a root (a missing parent, or a cycle) are not returned.

    Pointer doubling: every node knows an ancestor ``jump`` some ``hops`` above, and what lies between as a product of
    its steps (names, first own value). A round multiplies a node's product with that of the node it points to, so
    hops double and log2(depth) + 1 rounds reach every root. A round settles the depths 2^(k-1) to 2^k - 1; chains that
    lead to a root have all depths, so the first round that settles none is the last, whatever cycles remain.
    """
    own = F.col(inherit) if inherit else F.lit(None).cast("string")
    name = F.col(label).cast("string")
    names = F.array_compact(F.array(name)) if paths else F.array().cast("array<string>")
    state, settled = cut_lineage_counted(nodes.select(
        F.col(node_id).alias("id"), F.col(parent_id).alias("parent"), name.alias("name"), F.col(parent_id).alias("jump"),
        F.col(parent_id).isNotNull().cast("int").alias("hops"), names.alias("names"), own.alias("own")), "tree", F.col("jump").isNull())
    done, pending = state.where(F.col("jump").isNull()), state.where(F.col("jump").isNotNull())
    while settled:
        up = done.unionByName(pending).select(
            F.col("id").alias("_id"), F.col("jump").alias("_jump"), F.col("hops").alias("_hops"), F.col("names").alias("_names"), F.col("own").alias("_own"))
        state, settled = cut_lineage_counted(pending.join(up, F.col("jump") == F.col("_id")).select(
            "id", "parent", "name", F.col("_jump").alias("jump"), (F.col("hops") + F.col("_hops")).alias("hops"),
            F.concat("_names", "names").alias("names"), F.coalesce("own", "_own").alias("own")), "tree", F.col("jump").isNull())
        done, pending = done.unionByName(state.where(F.col("jump").isNull())), state.where(F.col("jump").isNotNull())
    path = F.array_join("names", "/") if paths else F.lit(None).cast("string")
    return done.select("id", "parent", "name", F.col("hops").alias("depth"), path.alias("path"), F.coalesce("own", F.lit(default)).alias("inherited"))


def domain_flatten(domains: DataFrame, owners: str | None = None, default_owner: str = "") -> DataFrame:
    """Domain tree (``id, parent_id, name``) as rows with depth, path and inherited owner."""
    return walk_tree(domains, "id", "parent_id", "name", owners, default_owner).withColumnRenamed("inherited", "owner")


def glossary_tree(terms: DataFrame) -> DataFrame:
    """Terms (``term, parent_term``) with their level; ``orphan`` marks those that never reach a root."""
    tree = walk_tree(terms, "term", "parent_term", "term", paths=False).select(F.col("id").alias("term"), F.col("depth").alias("level"))
    return terms.join(tree, "term", "left").withColumn("orphan", F.col("level").isNull())


def org_chain(employees: DataFrame) -> DataFrame:
    """Employee next to their manager's row; top of the tree has none."""
    boss = employees.select(F.col("employee_id").alias("manager_id"), F.col("department").alias("manager_department"),
                            F.col("salary_usd").alias("manager_salary_usd"))
    return employees.join(boss, "manager_id", "left")


def assets_without_lineage(assets: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """Assets that no edge leads into."""
    return assets.join(edges.select(F.col("dst").alias(id_col)).distinct(), id_col, "left_anti")


def orphan_edges(edges: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """Edge ends that are no known node: ``node, role, edges``, each counted once per role."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit("subject").alias("role")),
        F.struct(F.col("dst").alias("node"), F.lit("object").alias("role")),
    )).alias("e")).select("e.*").where(F.col("node").isNotNull())
    counted = ends.groupBy("node", "role").agg(F.count(F.lit(1)).alias("edges"))
    return counted.join(nodes.select(F.col(id_col).alias("node")).distinct(), "node", "left_anti")


def related_terms(triples: DataFrame, terms: DataFrame, id_col: str) -> DataFrame:
    """Both directions of every (subject, object) pair whose ends are known terms."""
    known = terms.select(F.col(id_col).alias("_t")).distinct()
    pairs = triples.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    valid = pairs.join(known, pairs["a"] == known["_t"], "left_semi").join(known, F.col("b") == known["_t"], "left_semi")
    back = F.array(F.struct(F.col("a").alias("term"), F.col("b").alias("related")),
                   F.struct(F.col("b").alias("term"), F.col("a").alias("related")))
    return valid.select(F.explode(back).alias("r")).select("r.*").distinct()
