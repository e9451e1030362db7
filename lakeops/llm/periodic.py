"""Periodic run detection: maximal pairs of an LCP-interval tree, read bottom-up with left-word class lists.

A run is a stretch of words with smallest period q, at least ``exponent`` periods and ``least`` words long, that no
neighbouring word extends. Two positions i < i + q form a maximal pair of length L (the words from both agree for
exactly L words, and the words before them differ) exactly where the words i .. i + q + L - 1 have period q and cannot
be extended. So runs are the maximal pairs with L >= max(least - q, (exponent - 1) * q); nothing is extended afterwards.

* Suffixes are sorted by prefix doubling, all texts of a run of documents at once; only suffixes that still tie are
  sorted again. The ranks of each doubling give the LCP values by binary descent.
* The tree is walked bottom-up where LCP values can carry a run. Every interval holds its positions in order, labelled
  by the word to their left; the smaller list is merged into the larger.
* Positions within L / (exponent - 1) of each other lie in one arithmetic progression whose members, but for the first,
  have one left word. So of the other class lists at most one position on each side can pair: the outermost on the
  left, the nearest on the right. Both are found by bisection, and no list is walked.

Documents are searched where they lie, without a shuffle; a text is searched whole.

Cases: a null, empty or word-free text has no words and no runs; words differ by their bytes (case counts); repeated
documents and null ids are rows like others; other columns are ignored; a table without rows gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm import common

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def doubled_ranks(keys: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, up to the level at which no two tie.

    ``keys`` are equal only for equal words of one text, and grow from text to text: suffixes of different texts
    never tie, and the end of a text counts as greater than its words.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int32)
    first = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
    sizes = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, sizes)
    levels, width = [rank], 1
    ties = order[np.repeat(sizes > 1, sizes)]
    while len(ties):
        ahead = ties + width
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], n).astype(np.int64)
        base = rank[ties].astype(np.int64)
        pair = base * (n + 1) + second
        again = np.argsort(pair, kind="stable")
        ties, pair, base = ties[again], pair[again], base[again]
        place = np.arange(len(ties))
        new = np.concatenate(([True], np.diff(pair) != 0))
        group = np.concatenate(([True], np.diff(base) != 0))
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(ties)))
        rank = rank.copy()
        rank[ties] = base + np.repeat(first, sizes) - np.maximum.accumulate(np.where(group, place, 0))
        levels.append(rank)
        ties = ties[np.repeat(sizes > 1, sizes)]
        width *= 2
    return levels


def common_lengths(levels: list[np.ndarray], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``one`` and ``other`` (never the same) have in common."""
    length = np.zeros(len(one), np.int64)
    for step in range(len(levels) - 1, -1, -1):
        rank = np.append(levels[step], -1)
        length += (rank[one + length] == rank[other + length]).astype(np.int64) << step
    return length


def maximal_pairs(positions: list[int], lengths: list[int], left: np.ndarray, reach: int) -> list[tuple[int, int, int]]:
    """(i, j, L) of the maximal pairs with j - i <= L / reach among suffixes in order, ``lengths`` being their LCPs."""
    found: list[tuple[int, int, int]] = []
    open_intervals: list[tuple[int, list[int]]] = []
    last = len(positions) - 1
    for k, position in enumerate(positions):
        node, depth = [position], lengths[k] if k < last else -1
        while open_intervals and open_intervals[-1][0] >= max(depth, 0):
            length, held = open_intervals.pop()
            node = _merged(held, node, length, left, reach, found)
            if length == depth:
                break
        open_intervals.append((depth, node))
    return found


def _merged(one: list[int], other: list[int], length: int, left: np.ndarray, reach: int, found: list) -> list[int]:
    """Two children of an interval as one list; pairs of different left words between them go to ``found``."""
    small, large = (one, other) if len(one) < len(other) else (other, one)
    far = length // reach
    for x in small:
        at = bisect_left(large, x)
        if at < len(large) and large[at] - x <= far and left[large[at]] != left[x]:
            found.append((x, large[at], length))
        if at and x - large[at - 1] <= far:
            j = large[bisect_left(large, x - far, 0, at)]
            if left[j] != left[x]:
                found.append((j, x, length))
    if len(small) * 8 < len(large):
        for x in small:
            insort(large, x)
        return large
    return sorted(large + small)


def runs_of_words(codes: np.ndarray, at: np.ndarray, least: int = 6, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; text d has the words at[d] .. at[d + 1] - 1."""
    empty = np.zeros(0, np.int64)
    shortest = min(max(least - q, (exponent - 1) * q) for q in range(1, least + 1))
    if len(codes) <= shortest:
        return empty, empty, empty
    texts = np.repeat(np.arange(len(at) - 1), np.diff(at))
    levels = doubled_ranks(texts * (int(codes.max()) + 1) + codes.astype(np.int64))
    suffixes = np.empty(len(codes), np.int64)
    suffixes[levels[-1]] = np.arange(len(codes))
    # only neighbours that agree for a power of two of words below the shortest length can agree for that length
    sure = levels[min(shortest.bit_length() - 1, len(levels) - 1)]
    near = np.flatnonzero(sure[suffixes[:-1]] == sure[suffixes[1:]])
    lengths = np.zeros(len(codes) - 1, np.int64)
    lengths[near] = common_lengths(levels, suffixes[near], suffixes[near + 1])
    deep = lengths >= shortest
    first = np.flatnonzero(deep & ~np.concatenate(([False], deep[:-1])))
    end = np.flatnonzero(deep & ~np.concatenate((deep[1:], [False]))) + 1
    if not len(first):
        return empty, empty, empty
    # a subtree whose closest positions are further apart than its longest match allows holds no run
    sizes = end - first + 1
    tree = np.repeat(np.arange(len(first)), sizes)
    inside = np.arange(len(tree)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
    places = suffixes[inside][np.lexsort((suffixes[inside], tree))]
    gaps = np.append(np.where(np.diff(tree) == 0, np.diff(places), len(codes)), len(codes))
    starts = np.cumsum(sizes) - sizes
    closest = np.minimum.reduceat(gaps, starts)
    longest = np.maximum.reduceat(np.where(np.append(np.diff(tree) == 0, False), lengths[np.minimum(inside, len(lengths) - 1)], 0), starts)
    left = np.empty(len(codes), np.int64)
    left[1:] = codes[:-1]
    left[at[:-1][np.diff(at) > 0]] = -1
    found = []
    for k in np.flatnonzero(closest * (exponent - 1) <= longest).tolist():
        found += maximal_pairs(suffixes[first[k]:end[k] + 1].tolist(), lengths[first[k]:end[k]].tolist(), left, exponent - 1)
    if not found:
        return empty, empty, empty
    i, j, length = np.array(found, np.int64).T
    period = j - i
    kept = length >= np.maximum(least - period, (exponent - 1) * period)
    start, period, length = i[kept], period[kept], (length + period)[kept]
    order = np.lexsort((period, length, start))
    start, period, length = start[order], period[order], length[order]
    # multiples of a period give the same stretch once more
    once = np.concatenate(([True], (np.diff(start) != 0) | (np.diff(length) != 0))) if len(start) else np.zeros(0, bool)
    start, period, length = start[once], period[once], length[once]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def find_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period in words, by start and period) and
    ``collapsed``: the words of no run but for its first period, joined by single spaces."""
    if exponent < 3 or least < exponent:
        raise ValueError("runs need an exponent of at least 3, and at least that many words")
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_finder(least, exponent), f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def _finder(least: int, exponent: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.runs(batches, "text"):
            data, offsets = common.raw_bytes_of(batch.column("text"))
            starts, ends, at = common.words_of(data, offsets, common.NOT_SPACE)
            joined, begin = common.joined_words(data, starts, ends)
            words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(begin), pa.py_buffer(joined)])
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            start, length, period = runs_of_words(codes, at, least, exponent)
            dropped = np.zeros(len(starts) + 1, np.int64)
            np.add.at(dropped, start + period, 1)
            np.add.at(dropped, start + length, -1)
            kept = np.cumsum(dropped[:-1]) == 0
            text, begin = common.joined_words(data, starts[kept], ends[kept])
            kept_at = np.concatenate(([0], np.cumsum(kept)))[at]
            collapsed = [text[begin[a]:max(begin[a], begin[b] - 1)].decode() for a, b in zip(kept_at[:-1], kept_at[1:], strict=True)]
            run_at = np.searchsorted(start, at)
            start = start - np.repeat(at[:-1], np.diff(run_at))
            runs = pa.ListArray.from_arrays(pa.array(run_at, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), runs, pa.array(collapsed, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    return find


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties go to the smallest start, then period. Null without runs."""
    better = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(best, r), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with repetition written into a tenth of the texts, chosen and placed by crc32 of the id as text
    (a null id counts as the empty text)."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n.cast("bigint"))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        index = F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda s: F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int")))[0]
        return F.array_join(F.transform(index, lambda i: words[i]), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    return docs.withColumn("text", F.when(h % 10 == 0, text).otherwise(F.col("text")))


def report(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """One row per document with repetition planted: n_runs, its strongest run, digests of all runs and of what is left."""
    found = find_runs(planted(docs.select("doc_id", "text")), least, exponent).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
