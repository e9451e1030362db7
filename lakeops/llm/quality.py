"""Quality classifier: a generalised additive model with pairwise interactions over text statistics.

Shallow trees are boosted cyclically, one feature at a time, on the binned features; the sum of a feature's trees is
its lookup table. Then the pairs that explain most of what is left get tables of two bins. Scoring adds table entries
by bin, whole arrays at a time.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows (those with the smallest hash of their id); features come
from whole texts, and every document is scored. Only text goes into a score.

Cases: a null text is empty, and an empty text has a score of its own (all statistics 0); repeated rows are scored
alike and learnt from once; null labels are not learnt from; without both labels the score is their share (0.5
without any); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm import common

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

#: Byte classes: 0 other, 1 small letter or beyond ASCII, 2 capital, 3 digit, 4 space, 5 line end, 6 stop, 7 quote or bracket, 8 symbol
_CLASS = np.zeros(256, np.int64)
_CLASS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[0x0A] = 5
_CLASS[[ord(c) for c in ".,;:?"]] = 6
_CLASS[[ord(c) for c in "\"'()[]{}-"]] = 7
_CLASS[[ord(c) for c in "#$%&*+/<=>@\\^_`|~!"]] = 8
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[[0x0A, 0x0D]] = False

FEATURES = (
    "log_bytes", "log_words", "log_lines", "small", "capital", "digit", "space", "stop", "quote", "symbol", "other",
    "word_length", "longest_word", "distinct_words", "top_word", "repeated_next", "short_words", "long_words",
    "words_with_symbol", "words_with_digit", "capital_words", "words_per_line", "distinct_lines", "words_per_stop",
    "distinct_per_log", "beyond_ascii",
)


def features_of(column: pa.Array) -> np.ndarray:
    """(rows, FEATURES) of whole texts."""
    data, offsets = common.raw_bytes_of(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    classes = _CLASS[data]
    counts = np.bincount(doc * 9 + classes, minlength=9 * n).reshape(n, 9)
    beyond = np.bincount(doc[data >= 0x80], minlength=n)
    starts, ends, at = common.words_of(data, offsets, common.NOT_SPACE)
    words, length = np.diff(at), ends - starts
    owner = np.repeat(np.arange(n), words)
    prints = common.fingerprints(common.LOWER[data], starts, ends)

    def share(mask: np.ndarray) -> np.ndarray:
        return _ratio(np.bincount(owner[mask], minlength=n), words)

    def has(*wanted: int) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(np.isin(classes, wanted))))
        return sums[ends] > sums[starts]

    distinct, top = _distinct(owner, prints, n)
    repeated = np.zeros(len(prints), bool)
    repeated[1:] = (prints[1:] == prints[:-1]) & (owner[1:] == owner[:-1])
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, length)
    line_starts, line_ends, line_at = common.words_of(data, offsets, _NOT_NEWLINE)
    lines = np.diff(line_at)
    line_distinct, _ = _distinct(np.repeat(np.arange(n), lines), common.fingerprints(data, line_starts, line_ends), n)
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(lines), *[_ratio(counts[:, k], size) for k in (1, 2, 3, 4, 6, 7, 8, 0)],
        _ratio(np.bincount(owner, weights=length, minlength=n), words), np.log1p(longest), _ratio(distinct, words), _ratio(top, words),
        share(repeated), share(length <= 3), share(length >= 12), share(has(8)), share(has(3)), share(has(2) & ~has(1)),
        _ratio(words, lines), _ratio(line_distinct, lines), _ratio(words, counts[:, 6] + 1), _ratio(distinct, np.sqrt(np.maximum(words, 1))),
        _ratio(beyond, size),
    ]
    return np.column_stack(columns).astype(np.float64) if n else np.zeros((0, len(FEATURES)))


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, a / np.maximum(b, 1), 0.0)


def _distinct(owner: np.ndarray, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner: how many different values, and how often the most frequent one comes."""
    order = np.lexsort((prints, owner))
    o, p = owner[order], prints[order]
    first = np.ones(len(p), bool)
    first[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(first)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, o[at], np.diff(np.append(at, len(p))))
    return np.bincount(o[at], minlength=n), top


@dataclass
class Gam:
    """Bin edges, one lookup table per feature, and tables of two bins for some pairs."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: the sum of the bins' entries, squashed."""
        total = np.full(len(x), self.bias)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float = 5.0) -> np.ndarray:
    """Values per bin of a tree on one binned feature: greedy splits of the gradient's and curvature's sums."""
    parts, cg, ch = [(0, len(g))], np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))

    def gain(a, b):
        return (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)

    while len(parts) < leaves:
        best = None
        for k, (a, b) in enumerate(parts):
            cuts = np.arange(a + 1, b)
            if len(cuts):
                won = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                c = int(np.argmax(won))
                if best is None or won[c] > best[0]:
                    best = won[c], k, int(cuts[c])
        if best is None or best[0] <= 1e-9:
            break
        a, b = parts[best[1]]
        parts[best[1]:best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 5.0) -> tuple[float, np.ndarray]:
    """(gain, values): the best cut of both bins into four quarters."""
    cg, ch = np.zeros(np.add(g.shape, 1)), np.zeros(np.add(g.shape, 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quarters(c):
        a = c[1:-1, 1:-1]
        return a, c[1:-1, -1:] - a, c[-1:, 1:-1] - a, c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + a

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    q = [(x, y) for x, y in zip(quarters(cg), quarters(ch), strict=True)]
    won = sum(x * x / (y + ridge) for x, y in q) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    i, j = np.unravel_index(int(np.argmax(won)), won.shape)
    out = np.empty(g.shape)
    for (x, y), rows, cols in zip(q, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None)) * 2, strict=True):
        out[rows, cols] = x[i, j] / (y[i, j] + ridge)
    return float(won[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, bins: int = 48, leaves: int = 4, pairs: int = 8, pair_rounds: int = 60, pair_bins: int = 12) -> Gam:
    """Boost the tables, feature by feature; keep those of the round that does best on every seventh row."""
    share = float(np.mean(y)) if len(y) else 0.5
    model = Gam(float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    if not len(y) or share in (0.0, 1.0):
        return model
    check = np.arange(len(y)) % 7 == 3
    model.edges = [_edges(x[:, k], bins) for k in range(x.shape[1])]
    model.pair_edges = [_edges(x[:, k], pair_bins) for k in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.pair_edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.bias)
    weight = (~check).astype(float)

    def sums(cells: np.ndarray, n: int):
        p = 1 / (1 + np.exp(-total))
        return np.bincount(cells, (y - p) * weight, n), np.bincount(cells, p * (1 - p) * weight, n)

    def loss() -> float:
        t = total[check]
        return float(np.mean(np.logaddexp(0, t) - y[check] * t)) if check.any() else 0.0

    best, kept, waited = loss(), [t.copy() for t in model.tables], 0
    for _ in range(rounds):
        for k, cells in enumerate(binned):
            step = rate * _shallow_tree(*sums(cells, len(model.tables[k])), leaves)
            model.tables[k] += step
            total += step[cells]
        now = loss()
        if now < best - 1e-6:
            best, kept, waited = now, [t.copy() for t in model.tables], 0
        elif (waited := waited + 1) >= 15:
            break
    model.tables = kept
    total = model.bias + sum(t[c] for t, c in zip(model.tables, binned, strict=True))
    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            shape = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
            g, h = sums(coarse[i] * shape[1] + coarse[j], shape[0] * shape[1])
            gains.append((_pair_tree(g.reshape(shape), h.reshape(shape))[0], i, j))
    chosen = [(i, j, np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1))) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    best, kept, waited = loss(), [(i, j, t.copy()) for i, j, t in chosen], 0
    for _ in range(pair_rounds):
        for i, j, table in chosen:
            cells = coarse[i] * table.shape[1] + coarse[j]
            g, h = sums(cells, table.size)
            step = rate * _pair_tree(g.reshape(table.shape), h.reshape(table.shape))[1]
            table += step
            total += step.ravel()[cells]
        now = loss()
        if now < best - 1e-6:
            best, kept, waited = now, [(i, j, t.copy()) for i, j, t in chosen], 0
        elif (waited := waited + 1) >= 10:
            break
    model.pairs = kept
    return model


def train(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, folds: int = FOLDS, held_out: int = HELD_OUT) -> Gam:
    """Fit on at most ``most_rows`` labelled rows outside the held-out fold."""
    chosen = (
        labels.where((common.fold_of(F.col("doc_id"), folds) != held_out) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # most_rows rows of two numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.runs(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), batch.column("hash"), pa.array(list(features_of(batch.column("text"))), pa.list_(pa.float64()))],
                names=["doc_id", "quality", "hash", "x"])

    texts = texts.select("doc_id", "quality", F.xxhash64("text").alias("hash"), "text")
    rows = texts.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, hash bigint, x array<double>")
    # of the texts of one id the one with the smallest hash, whatever order the rows come in
    one = rows.groupBy("doc_id").agg(F.min(F.struct("hash", "quality", "x")).alias("row")).select("doc_id", "row.quality", "row.x")
    rows = sorted(one.collect())
    return fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.quality for r in rows], float))


def _scores(model, batch: pa.RecordBatch) -> np.ndarray:
    return model.value.score(features_of(batch.column("text")))


def report(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most_rows))
    texts = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.runs(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model, batch))], names=["doc_id", "score"])

    scored = texts.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (common.fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most_rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.runs(batches, "text"):
            yield batch.filter(pa.array(_scores(model, batch) >= threshold))

    return docs.mapInArrow(work, docs.schema)
