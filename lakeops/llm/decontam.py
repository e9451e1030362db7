"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Symbols are words (``[a-z0-9]`` and everything beyond ASCII, A-Z lower-cased). Patterns are the windows of the test
items: ``window`` consecutive words, or a shorter item's whole words. Patterns of one length are searched together:

* a shift table says for a block of two words (by fingerprint, folded into 2^20 slots) how far the search may jump;
* where the shift is 0, the block's suffix bucket names the patterns that end with it;
* the pattern's bytes are compared with the document's: only an equal text is an occurrence.

Documents are searched where they lie, without a shuffle. The items are a bounded set: their windows are broadcast in
blocks of at most ``block_bytes`` of text, and each block is searched over all documents.

Cases: a null or word-free text has no words and is clean; items with a null id, or without words, are no items;
equal windows of several items count for each; repeated documents are separate rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lakeops.llm import common

WINDOW = 10
#: Bytes of item text in one broadcast block of patterns.
BLOCK_BYTES = 8 << 20
#: Words that one lane of the search walks through (besides the pattern's length).
LANE = 512
_SLOTS = 1 << 20


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[list[tuple[int, str]]]:
    """The items in blocks of bounded text, read one after the other."""
    blocks, room = [[]], block_bytes
    rows = items.select(F.col("item_id"), F.col("text")).where("item_id is not null and text is not null").distinct()
    for row in rows.toLocalIterator():
        if room <= 0:
            blocks.append([])
            room = block_bytes
        blocks[-1].append((row.item_id, row.text))
        room -= len(row.text)
    return blocks


class Matcher:
    """Tables of one block of items; built once in each Python worker."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        data, offsets = common.bytes_of(pa.array([t for _, t in items], pa.large_string()))
        starts, ends, at = common.words_of(data, offsets, common.ALNUM)
        prints = common.fingerprints(data, starts, ends)
        text, begin = common.joined_words(data, starts, ends)
        owners: dict[bytes, set[int]] = {}
        places: dict[bytes, int] = {}
        sizes: dict[bytes, int] = {}
        for k, (item, _) in enumerate(items):
            first, end = int(at[k]), int(at[k + 1])
            size = min(window, end - first)
            for i in range(first, end - size + 1) if size else ():
                pattern = text[begin[i]:begin[i + size] - 1]
                owners.setdefault(pattern, set()).add(item)
                places[pattern], sizes[pattern] = i, size
        self.patterns = list(owners)
        self.owners = [owners[p] for p in self.patterns]
        self.groups = []
        for size in sorted(set(sizes.values())):
            own = [k for k, p in enumerate(self.patterns) if sizes[p] == size]
            words = prints[np.array([places[self.patterns[k]] for k in own])[:, None] + np.arange(size)]
            width = min(2, size)
            blocks = _blocks(words, width)
            shift = np.full(_SLOTS, size - width + 1, np.int64)
            for j in range(size - width + 1):
                np.minimum.at(shift, (blocks[:, j] % np.uint64(_SLOTS)).astype(np.int64), size - width - j)
            order = np.argsort(blocks[:, -1], kind="stable")
            self.groups.append((size, width, shift, blocks[order, -1], np.array(own)[order]))

    def search(self, prints, text: bytes, begin, at) -> tuple[np.ndarray, list[set[int]]]:
        """(hit words, items per document) of a run of documents given by their words."""
        hit = np.zeros(len(prints) + 1, np.int64)
        found: list[set[int]] = [set() for _ in range(len(at) - 1)]
        for size, width, shift, suffixes, own in self.groups:
            if len(prints) < width:
                continue
            blocks = _blocks(prints[None, :], width)[0]
            slots = (blocks % np.uint64(_SLOTS)).astype(np.int64)
            # lanes: starts of windows [low, high) of one document; the block under the cursor ends the window
            low = np.concatenate([np.arange(a, max(a, b - size + 1), LANE) for a, b in zip(at[:-1], at[1:], strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
            doc = np.searchsorted(at, low, side="right") - 1
            high = np.minimum(low + LANE, at[doc + 1] - size + 1)
            candidates = []
            while len(low):
                jump = shift[slots[low + size - width]]
                if (stop := jump == 0).any():
                    candidates.append(low[stop])
                low = low + np.maximum(jump, 1)
                keep = low < high
                low, high = low[keep], high[keep]
            if not candidates:
                continue
            windows = np.concatenate(candidates)
            keys = blocks[windows + size - width]
            first, end = np.searchsorted(suffixes, keys, side="left"), np.searchsorted(suffixes, keys, side="right")
            some = end > first
            windows, first, end = windows[some], first[some], end[some]
            docs = np.searchsorted(at, windows, side="right") - 1
            for w, d, a, b in zip(windows.tolist(), docs.tolist(), first.tolist(), end.tolist(), strict=True):
                here = text[begin[w]:begin[w + size] - 1]
                for k in own[a:b]:
                    if self.patterns[k] == here:
                        hit[w] += 1
                        hit[w + size] -= 1
                        found[d] |= self.owners[k]
                        break
        return np.cumsum(hit[:-1]) > 0, found


def _blocks(words: np.ndarray, width: int) -> np.ndarray:
    if width == 1:
        return words
    return common.mix(words[:, :-1] * np.uint64(0x9E3779B97F4A7C15) + words[:, 1:])


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, text, n_words, hit_words (positions of hit words), items (sorted ids)."""
    return _found(docs, items, window, block_bytes, True)


def _found(docs: DataFrame, items: DataFrame, window: int, block_bytes: int, keep_text: bool) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_words bigint, hit_words array<int>, items array<{item}>"
    blocks = item_blocks(items, block_bytes)
    out = docs.withColumns({"n_words": F.lit(0).cast("bigint"), "hit_words": F.array().cast("array<int>"), "items": F.array().cast(f"array<{item}>")}) if not blocks[0] else docs
    for n, block in enumerate(blocks):
        # a later block adds to what the earlier ones found in the same row
        out = out.mapInArrow(_searcher(sc.broadcast(block), window, keep_text or n + 1 < len(blocks), to_arrow_type(items.schema["item_id"].dataType)), schema)
    return out


def _searcher(block, window: int, keep_text: bool, item: pa.DataType):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value, window)
        for batch in common.runs(batches, "text"):
            data, offsets = common.bytes_of(batch.column("text"))
            starts, ends, at = common.words_of(data, offsets, common.ALNUM)
            text, begin = common.joined_words(data, starts, ends)
            hit, found = matcher.search(common.fingerprints(data, starts, ends), text, begin, at)
            positions = [np.flatnonzero(hit[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            if "items" in batch.schema.names:
                found = [f | set(e) for f, e in zip(found, batch.column("items").to_pylist(), strict=True)]
                positions = [np.union1d(p, e) for p, e in zip(positions, batch.column("hit_words").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text") if keep_text else pa.nulls(batch.num_rows, pa.string()),
                pa.array(np.diff(at), pa.int64()), pa.array([p.astype(np.int32) for p in positions], pa.list_(pa.int32())),
                pa.array([sorted(f, key=str) for f in found], pa.list_(item))], names=["doc_id", "text", "n_words", "hit_words", "items"])

    return search


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = _found(docs, items, window, block_bytes, False)
    n_hit = F.size("hit_words").cast("bigint")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.col("items").cast("array<string>")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a window of an item; all columns stay."""
    sc, names = docs.sparkSession.sparkContext, docs.columns
    for block in item_blocks(items, block_bytes):
        docs = docs.mapInArrow(_dropper(sc.broadcast(block), window), docs.schema)
    return docs.select(names)


def _dropper(block, window: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value, window)
        for batch in common.runs(batches, "text"):
            data, offsets = common.bytes_of(batch.column("text"))
            starts, ends, at = common.words_of(data, offsets, common.ALNUM)
            text, begin = common.joined_words(data, starts, ends)
            hit, _ = matcher.search(common.fingerprints(data, starts, ends), text, begin, at)
            hits = np.concatenate(([0], np.cumsum(hit)))
            yield batch.filter(pa.array(hits[at[1:]] == hits[at[:-1]]))

    return clean
