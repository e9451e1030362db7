"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at few differing bits by vantage-point trees.

* Fingerprint: per bit, is it set in more than half of the XXH64 (seed 42) of the text's 3-word shingles?
* Equal fingerprints fold into one before anything is compared, so groups of copies cost one row.
* A vantage-point tree over a bounded sample of fingerprints splits the Hamming space into shards. A fingerprint
  lives in one shard and is also sent to each shard that a point within ``radius`` of it may lie in (the triangle
  inequality says which). So each linked pair meets in the shard of either of the two.
* Inside a shard the same tree is grown on: residents and visitors walk down together, branches beyond the triangle
  bound are pruned, leaves compare directly (bit counts). A shard emits a forest, not pairs: one row per fingerprint.
* Components over all shards come from label passing over those rows, each round written to the shared folder.

Cases: null and word-free texts have fingerprint zero and link like any other; fewer than three words make one
shingle of the whole sequence; repeated rows and repeated ids stay rows of the result; a null id never names a
component unless all ids are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm import common

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints of the sample that the upper tree is grown on.
SAMPLE = 65_536
#: Fingerprints a shard is meant to hold; more only make the shard's own tree deeper.
SHARD_ROWS = 16_384
#: Fingerprints of a leaf that are compared directly.
LEAF = 256


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): the SimHash of every row's whole text; text_hash tells rows of one id apart."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.runs(batches, "text"):
            data, offsets = common.bytes_of(batch.column("text"))
            starts, ends, at = common.words_of(data, offsets, common.NOT_SPACE)
            text, begin = common.joined_words(data, starts, ends)
            begin = begin.tolist()
            prints = np.zeros(batch.num_rows, np.uint64)
            for k, (first, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                if first < end:
                    width = min(shingle, end - first)
                    digest = xxhash.xxh64_intdigest
                    prints[k] = majority(np.array([digest(text[begin[i]:begin[i + width] - 1], SEED) for i in range(first, end - width + 1)], np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash bigint, fp bigint")


def majority(hashes: np.ndarray, run: int = 1 << 15) -> np.uint64:
    """Bits set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), run):
        part = np.ascontiguousarray(hashes[k:k + run]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Tree:
    """Vantage points of the upper levels: inner nodes (point, bound, near, far), leaves are shard numbers."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.shards = 0
        self.root = self._grow(sample, shards)

    def _grow(self, sample: np.ndarray, shards: int) -> int:
        split = pick_vantage(sample) if shards > 1 and len(sample) > 1 else None
        if split is None:
            self.shards += 1
            return -self.shards
        point, bound, near = split
        me = len(self.nodes)
        self.nodes.append((0, 0, 0, 0))
        a = self._grow(sample[near], shards // 2)
        b = self._grow(sample[~near], shards - shards // 2)
        self.nodes[me] = (int(point), bound, a, b)
        return me

    def route(self, prints: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, rows that it may concern, which of them live there)."""
        todo = [(self.root, np.arange(len(prints)), np.ones(len(prints), bool))]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node - 1, rows, home
                continue
            point, bound, near, far = self.nodes[node]
            d = distance(prints[rows], np.uint64(point))
            inner, outer = d <= bound + radius, d > bound - radius
            todo.append((near, rows[inner], home[inner] & (d[inner] <= bound)))
            todo.append((far, rows[outer], home[outer] & (d[outer] > bound)))


def pick_vantage(points: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """(vantage point, bound, who is within it) nearest to halves, of a few points; None if none tells points apart."""
    best = None
    seen = points if len(points) <= 4096 else points[:: len(points) // 4096]
    for point in points[:: max(1, len(points) // 8)][:8]:
        d = distance(seen, point)
        counts = np.bincount(d, minlength=65).cumsum()
        bound = int(np.argmin(np.abs(2 * counts[:-1] - len(d))))
        # prefer even halves with few points at the border
        cost = abs(2 * counts[bound] - len(d)) + ((d > bound - RADIUS) & (d <= bound + RADIUS)).sum()
        if 0 < counts[bound] < len(d) and (best is None or cost < best[0]):
            best = cost, point, bound
    if best is None:
        return None
    near = distance(points, best[1]) <= best[2]
    return best[1], best[2], near


class Forest:
    """Union-find over rows, by whole arrays of pairs: labels fall to the smallest until nothing changes."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            if not len(a):
                return
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(self.label, high, low)
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def link_shard(prints: np.ndarray, home: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> np.ndarray:
    """For each row the row that names its group, linking residents (``home``) with all rows within ``radius``."""
    forest = Forest(len(prints))
    todo = [(np.flatnonzero(home), np.arange(len(prints)))]
    while todo:
        residents, visitors = todo.pop()
        if not len(residents) or not len(visitors):
            continue
        split = pick_vantage(prints[residents]) if len(residents) > leaf else None
        if split is None:
            # direct comparison, in blocks of bounded size
            step = max(1, (1 << 20) // len(residents))
            for k in range(0, len(visitors), step):
                rows = visitors[k:k + step]
                i, j = np.nonzero(np.bitwise_count(prints[rows][:, None] ^ prints[residents][None, :]) <= radius)
                forest.join(rows[i], residents[j])
            continue
        point, bound, near = split
        d = distance(prints[visitors], point)
        todo.append((residents[near], visitors[d <= bound + radius]))
        todo.append((residents[~near], visitors[d > bound - radius]))
    return forest.label


def links(distinct: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(fp, other): for distinct fingerprints ``fp``, edges that connect all those within ``radius`` of each other."""
    spark = distinct.sparkSession
    n = distinct.count()
    # a bounded sample, by a hash so that it does not depend on the order of rows
    share = min(1.0, sample / max(n, 1))
    some = distinct.where(F.pmod(F.hash("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("fp").limit(2 * sample)
    points = np.sort(np.array([r.fp for r in some.collect()], np.int64)).view(np.uint64)
    tree = spark.sparkContext.broadcast(Tree(np.random.default_rng(SEED).permutation(points), max(1, -(-n // shard_rows))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy().view(np.uint64)
            for shard, rows, home in tree.value.route(prints, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, np.int32)), pa.array(prints[rows].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def link(table: pa.Table) -> pa.Table:
        prints = table.column("fp").to_numpy().view(np.uint64)
        label = link_shard(prints, table.column("home").to_numpy(), radius)
        rows = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"fp": prints[rows].view(np.int64), "other": prints[label[rows]].view(np.int64)})

    return (
        distinct.select("fp").mapInArrow(route, "shard int, fp bigint, home boolean")
        .groupBy("shard").applyInArrow(link, "fp bigint, other bigint")
    )


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(fp, root): the smallest fingerprint reachable over ``edges`` (fp, other), for fingerprints that have any.

    Each round every node points to the smallest label around it, and labels of labels are followed (so chains halve);
    a round is written before the next one reads it.
    """
    both = common.cut(edges.select("fp", "other").union(edges.select("other", "fp")).distinct(), "simhash-edges")
    label = common.cut(both.groupBy("fp").agg(F.least("fp", F.min("other")).alias("root")), "simhash-labels")
    for _ in range(most_rounds):
        around = both.join(label.select(F.col("fp").alias("other"), "root"), "other").groupBy("fp").agg(F.min("root").alias("near"))
        hooked = (
            label.join(around, "fp").select(F.col("root").alias("fp"), F.least("root", "near").alias("root"))
            .union(label.join(around, "fp").select("fp", F.least("root", "near").alias("root"))).groupBy("fp").agg(F.min("root").alias("root"))
        )
        jumped = hooked.join(hooked.select(F.col("fp").alias("root"), F.col("root").alias("next")), "root", "left").select("fp", F.coalesce("next", "root").alias("root"))
        new = common.cut(jumped, "simhash-labels")
        changed = new.join(label, "fp").where(new["root"] != label["root"]).limit(1).count()
        label = new
        if not changed:
            return label
    raise RuntimeError("components did not settle")


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row; component_id is the smallest id of the linked rows,
    root the smallest fingerprint (two groups of rows with one id differ in it)."""
    spark = docs.sparkSession
    prints = common.cut(fingerprints(docs), "simhash-prints")
    distinct = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    roots = components(links(distinct, radius))
    named = distinct.join(roots, "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.cut(named.join(least, "root").select("fp", "n", "root", "component_id"), "simhash-named")
    # fingerprints of over one row in 2,000 are fewer than 2,000: they are joined by broadcast, so no task gets a hot one
    bound = max((named.agg(F.sum("n")).first()[0] or 0) // 2000, 1)
    hot = F.broadcast(named.where(F.col("n") > bound).select("fp", F.struct("root", "component_id").alias("hot")))
    rest = named.where(F.col("n") <= bound).drop("n")
    marked = prints.join(hot, "fp", "left")
    columns = ["doc_id", "text_hash", "fp", "root", "component_id"]
    return marked.where("hot is not null").select("doc_id", "text_hash", "fp", "hot.*").union(
        marked.where("hot is null").drop("hot").join(rest, "fp").select(columns))


def report(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: fingerprint (16 hex digits) and component_id."""
    return groups(docs, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group: the smallest id, then the smallest hash of the text, then of all columns."""
    names = docs.columns
    first = groups(docs, radius).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    kept = first.select("row.*").select(key.alias("__id"), F.col("text_hash").alias("__hash"))
    return (
        docs.withColumns({"__id": key, "__hash": F.xxhash64("text")})
        .join(kept, ["__id", "__hash"], "left_semi").groupBy("__id", "__hash")
        .agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("__row")).select("__row.*")
    )
