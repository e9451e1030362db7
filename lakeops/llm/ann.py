"""Approximate nearest neighbours: one navigable small-world graph per shard, as flat neighbour arrays; results are merged.

* Equal vectors are one node with the smallest ids that share it (``k`` + 1 suffice: no answer can name more), so
  thousands of copies cost one node and ties go to the smaller id exactly.
* Nodes are dealt to shards of about ``SHARD_ROWS`` by a hash of the vector. A shard's graph is built in one task and is
  one row: vectors, ids, and for each level an array of neighbours. Shards follow the input; each is bounded.
* Queries go in blocks of about ``BLOCK`` to every shard: tasks read some shards and some blocks from the shared folder,
  so no block is copied for each shard, by a shuffle or through the driver. Each shard answers with its ``k`` nearest,
  and the best ``k`` of all answers are kept. Distances are Euclidean, in double precision on the original vectors.

Cases: rows without an id, and vectors that are null, empty, all zero or hold null or non-finite components, take no
part; of rows with one id the one with the smallest vector counts; vectors of different lengths never meet; with fewer
than ``k`` candidates all are returned; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm import common

K = 10
#: Vectors per shard, about.
SHARD_ROWS = 4096
#: Queries per block.
BLOCK = 256
#: Links per node (twice as many on the lowest level), and how many nearest nodes a search keeps while building and asking.
LINKS, WIDTH_BUILD, WIDTH_ASK = 12, 64, 96


class Graph:
    """A hierarchical navigable small-world graph over rows of ``vectors``."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, levels: list[np.ndarray] | None = None, entry: int = 0):
        self.vectors, self.links, self.entry = vectors, links, entry
        self.levels = levels if levels is not None else []
        self.seen = np.zeros(len(vectors), np.int64)
        self.stamp = 0

    def distances(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        d = self.vectors[rows] - q
        return np.einsum("ij,ij->i", d, d)

    def nearest(self, q: np.ndarray, entries: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest rows found from ``entries`` on one level, nearest first."""
        self.stamp += 1
        seen, stamp, links = self.seen, self.stamp, self.levels[level]
        seen[[row for _, row in entries]] = stamp
        open_ = list(entries)
        heapq.heapify(open_)
        best = [(-d, row) for d, row in entries]
        heapq.heapify(best)
        while open_:
            d, row = heapq.heappop(open_)
            if len(best) >= width and d > -best[0][0]:
                break
            near = links[row]
            near = near[near >= 0]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            for d, row in zip(self.distances(q, near).tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-d, row))
                    heapq.heappush(open_, (d, row))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, row))
                    heapq.heappush(open_, (d, row))
        return sorted((-d, row) for d, row in best)

    def spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """At most ``most`` of the rows found: each nearer to the new row than to any kept before it, then the nearest left."""
        if len(found) <= most:
            return [row for _, row in found]
        rows = np.array([row for _, row in found])
        v = self.vectors[rows]
        square = np.einsum("ij,ij->i", v, v)
        between = square[:, None] + square[None, :] - 2 * (v @ v.T)
        kept: list[int] = []
        closest = np.full(len(rows), np.inf)
        for k, (d, _) in enumerate(found):
            if d < closest[k]:
                kept.append(k)
                if len(kept) == most:
                    break
                np.minimum(closest, between[k], out=closest)
        for k in range(len(rows)):
            if len(kept) == most:
                break
            if k not in kept:
                kept.append(k)
        return rows[kept].tolist()

    def build(self, width: int = WIDTH_BUILD, seed: int = 42) -> Graph:
        n = len(self.vectors)
        tops = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(self.links)).astype(int), 8)
        self.levels = [np.full((n, self.links * (2 if level == 0 else 1)), -1, np.int32) for level in range(int(tops.max(initial=0)) + 1)]
        for row in range(1, n):
            q, top = self.vectors[row], int(tops[row])
            at = [(float(self.distances(q, np.array([self.entry]))[0]), self.entry)]
            high = int(tops[self.entry])
            for level in range(high, -1, -1):
                at = self.nearest(q, at, width if level <= top else 1, level)
                if level <= top:
                    self._connect(row, at, level)
            if top > high:
                self.entry = row
        return self

    def _connect(self, row: int, found: list[tuple[float, int]], level: int) -> None:
        links = self.levels[level]
        chosen = self.spread(found, self.links)
        links[row, :len(chosen)] = chosen
        for other in chosen:
            own = links[other]
            free = np.flatnonzero(own < 0)
            if len(free):
                own[free[0]] = row
            else:
                rows = np.append(own, row)
                ranked = sorted(zip(self.distances(self.vectors[other], rows).tolist(), rows.tolist(), strict=True))
                own[:] = -1
                kept = self.spread(ranked, len(own))
                own[:len(kept)] = kept

    def ask(self, q: np.ndarray, width: int = WIDTH_ASK) -> list[int]:
        """Rows near ``q``, nearest first."""
        if not len(self.vectors):
            return []
        at = [(float(self.distances(q, np.array([self.entry]))[0]), self.entry)]
        for level in range(len(self.levels) - 1, 0, -1):
            at = self.nearest(q, at, 1, level)
        return [row for _, row in self.nearest(q, at, width, 0)]


def usable(vector: Column) -> Column:
    """Not null or empty, every component finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def nodes(vectors: DataFrame, k: int = K) -> DataFrame:
    """(ids, vector): distinct vectors with the ``k`` + 1 smallest ids of the rows that share each, repeats included."""
    fine = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("vector")), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    return fine.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def build_index(found: DataFrame, shards: int) -> DataFrame:
    """One row per (dim, shard): vectors, ids and the graph's flat arrays."""
    def build(table: pa.Table) -> pa.Table:
        vectors = np.array(table["vector"].to_pylist(), np.float64)
        order = np.lexsort(vectors.T[::-1])  # the same graph whatever order the rows came in
        ids = table["ids"].to_pylist()
        graph = Graph(vectors[order]).build()
        return pa.table({
            "dim": table["dim"].slice(0, 1), "shard": table["shard"].slice(0, 1), "entry": pa.array([graph.entry], pa.int32()),
            "vectors": pa.array([graph.vectors.tobytes()], pa.binary()),
            "ids": pa.array([[ids[i] for i in order]], pa.list_(pa.list_(pa.int64()))),
            "levels": pa.array([[level.tobytes() for level in graph.levels]], pa.list_(pa.binary()))})

    dealt = found.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), "vector", "ids")
    return dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, entry int, vectors binary, ids array<array<bigint>>, levels array<binary>")


def _searcher(k: int, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, graph, ids = None, None, None
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n] for name in batch.schema.names}
                if key != (key := (row["dim"].as_py(), row["shard"].as_py())) or graph is None:
                    vectors = np.frombuffer(row["vectors"].as_py(), np.float64).reshape(-1, key[0])
                    levels = [np.frombuffer(x, np.int32).reshape(len(vectors), -1) for x in row["levels"].as_py()]
                    graph, ids = Graph(vectors, levels=levels, entry=row["entry"].as_py()), row["ids"].as_py()
                out = []
                for query in row["queries"].as_py():
                    q = np.array(query["vector"], np.float64)
                    rows = graph.ask(q, width)
                    d = np.sqrt(((graph.vectors[rows] - q) ** 2).sum(axis=1)).tolist()
                    best = []
                    for x, r in zip(d, rows, strict=True):
                        near = list(ids[r])
                        if query["vec_id"] in near and np.array_equal(graph.vectors[r], q):
                            near.remove(query["vec_id"])  # the query's own row; rows like it stay
                        best += [(x, i) for i in near]
                    out += [(query["vec_id"], query["part"], i, x) for x, i in sorted(best)[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "part", "vec_id", "score"])

    return work


def search(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, block: int = BLOCK, width: int = WIDTH_ASK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each distinct query row its ``k`` nearest rows but itself."""
    found = common.cut(nodes(vectors, k), "ann-nodes")
    shards = max(1, -(-found.count() // shard_rows))
    index = common.cut(build_index(found, shards), "ann-index")
    asked = queries.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("vector")), F.lit(False)))
    asked = common.cut(asked.distinct().withColumn("part", F.xxhash64("vector")), "ann-queries")
    blocks = max(1, -(-asked.count() // block))
    blocks = common.cut(asked.groupBy(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("vec_id", "part", "vector")).alias("queries")).select("dim", "queries"), "ann-blocks")
    # a block goes to each shard there is; tasks read both from the shared folder, so nothing is copied by a shuffle or sent through the driver
    answers = index.hint("shuffle_replicate_nl").join(blocks, "dim").select("dim", "shard", "entry", "vectors", "ids", "levels", "queries").mapInArrow(_searcher(k, width), "query_id bigint, part bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "part").orderBy("score", "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    """The ten nearest of every row whose id is divisible by 100, among all other rows."""
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
