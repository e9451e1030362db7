"""Language-model scoring: a log-frequency Bloom filter holds quantised n-gram counts, each worker that part it probes.

A count c is stored as its level, 1 + floor(log_1.5 c): an n-gram is put in once for each level up to its own, and its
level is read back by probing level after level until one is missing. Words and pairs of neighbouring words are held.
A text's probability interpolates both: P(w|v) = a * c(v,w)/c(v) + (1-a) * (c(w)+1)/(N+V+1), with one weight ``a`` per
level of c(v), fitted by expectation maximisation on all training texts with each pair's own occurrence left out.

* Packing: the texts are read once into packs of about a million tokens, each a row of its words' 64-bit fingerprints
  and of every token's place among them. What follows reads packs, not texts.
* Counting and probing: a pack's different n-grams travel once, with how often training texts hold them, to the
  segments (fingerprint modulo the number of segments, which follows the input). A segment is one task: it adds the
  counts up, builds its part of the filter, probes it for all that it was sent and answers each pack. Fingerprints
  spread evenly, and a frequent n-gram is one number per pack, so there are no hot groups.
* A pack and its answers meet by the pack's number. So every n-gram of a pack is sent once and answered once: what is
  written and what is done grow as the input does, at any size, and no part of the model passes through the driver.
* Word counts stay exact beside the filter; they give the base score and the counts N and V.

Words are told apart by 64-bit fingerprints: among V different words some two share one with a chance of about
V * V / 2^65 (10 million words: 1 in 370,000), which would add their counts up.

Cases: a null text is empty and consists of its end only; a null id counts as the empty text for the fold; repeated
rows count and are scored each; without training texts N and V are 0 and every word is unknown; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm import common

FOLDS, HELD_OUT = 7, 2
#: Text bytes per segment of the model.
SEGMENT_BYTES = 16 << 20
#: Bytes of work arrays that a task gathers in a round before it packs them, and how many a token takes.
ROUND_BYTES = 96 << 20
TOKEN_BYTES = 96
#: Packs in one file, so that a reader's batch of rows stays small.
FILE_PACKS = 16
#: Filter bits per entry, and bits set by each entry (all in one 64-bit word of the filter).
BITS_PER_ENTRY, BITS_SET = 12, 4
#: A level's counts grow by this factor.
LEVEL_BASE = 1.5
LEVELS = 64

_END = common.mix(np.array([0xE0D], np.uint64))[0]
_START = common.mix(np.array([0x57A87], np.uint64))[0]
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_SENT = "segment int, pack bigint, words binary, word_counts binary, pairs binary, pair_counts binary"
_ANSWER = "segment int, pack bigint, n_tokens bigint, n_words bigint, word_levels binary, word_counts binary, pair_levels binary"
_ZSTD = {"compression": "zstd"}

#: First count of each level, and the mean count of a level.
_FIRST = np.ceil(LEVEL_BASE ** np.arange(LEVELS + 1) - 1e-9)
_VALUE = np.concatenate(([0.0], np.maximum((_FIRST[:-1] + np.maximum(_FIRST[1:] - 1, _FIRST[:-1])) / 2, 1)))


def levels_of(counts: np.ndarray) -> np.ndarray:
    """The level of each count (0 for none)."""
    return np.minimum(np.searchsorted(_FIRST, counts, side="right"), LEVELS)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words with one end per text as fingerprints, how many each text has)."""
    data, offsets = common.bytes_of(column)
    starts, ends, at = common.words_of(data, offsets, common.NOT_SPACE)
    n = len(offsets) - 1
    begin = at + np.arange(n + 1)
    words = np.full(begin[-1], _END, np.uint64)
    inside = np.ones(len(words), bool)
    inside[begin[1:] - 1] = False
    words[inside] = common.fingerprints(data, starts, ends)
    return words, np.diff(begin)


def _pairs(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Pairs with the word before as fingerprints."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(lengths) - lengths] = _START
    return common.mix(before * _PAIR + words)


def _count(arrays: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([a for a, _ in arrays]), np.concatenate([c for _, c in arrays])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts.astype(np.int64)


def _packer(tokens: int):
    """Packs of at least ``tokens`` tokens (a task's last may have fewer)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def pack():
            ids, flags = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
            distinct, at = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
            whole = pa.array([0, len(ids)], pa.int32())
            arrays = [pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, flags)]
            arrays += [pa.array([x.tobytes()], pa.binary()) for x in (np.concatenate([h[3] for h in held]).astype(np.int64), distinct, at.astype(np.uint16 if len(distinct) <= 1 << 16 else np.uint32))]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["doc_ids", "held_out", "lengths", "words", "tokens"])

        for batch in common.runs(batches, "text"):
            held.append((batch.column("doc_id"), batch.column("held_out"), *_words(batch.column("text"))))
            if sum(len(h[2]) for h in held) >= tokens:
                yield pack()
        if held:
            yield pack()

    return work


class Pack:
    """A row of the packs: its different words and pairs, and where each token's are among them."""

    def __init__(self, table: pa.RecordBatch | pa.Table, row: int):
        one = {name: table.column(name)[row] for name in table.schema.names}
        self.number, self.ids, self.held_out = one["pack"].as_py(), one["doc_ids"].values, one["held_out"].values
        lengths, words, tokens = (one[name].as_buffer() for name in ("lengths", "words", "tokens"))
        self.lengths, self.words = np.frombuffer(lengths, np.int64), np.frombuffer(words, np.uint64)
        self.word_at = np.frombuffer(tokens, np.uint16 if len(self.words) <= 1 << 16 else np.uint32)
        self.pairs, self.pair_at = np.unique(_pairs(self.words[self.word_at], self.lengths), return_inverse=True)


def _by_segment(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys by segment, where each segment begins and the last one ends)."""
    # two bytes are sorted by radix, in linear time
    where = (keys % np.uint64(segments)).astype(np.uint16 if segments <= 1 << 16 else np.int64)
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(segments + 1))


def _cut_up(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of ``values`` between each two cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _sender(segments: int):
    """A pack's words and pairs by segment, each with its count in the pack's training texts (0 where only others hold it)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pack = Pack(batch, row)
                train = np.repeat(~pack.held_out.to_numpy(zero_copy_only=False), pack.lengths)
                columns = []
                for keys, at in ((pack.words, pack.word_at), (pack.pairs, pack.pair_at)):
                    order, cuts = _by_segment(keys, segments)
                    columns += [_cut_up(keys[order], cuts), _cut_up(_narrow(np.bincount(at[train], minlength=len(keys))[order]), cuts)]
                sent = pa.RecordBatch.from_arrays([pa.array(np.arange(segments, dtype=np.int32)), pa.array(np.full(segments, pack.number)), *columns], names=["segment", "pack", "words", "word_counts", "pairs", "pair_counts"])
                yield sent.filter(pc.or_(pc.greater(pc.binary_length(columns[0]), 0), pc.greater(pc.binary_length(columns[2]), 0)))

    return work


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte each where all fit."""
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32)


def _widen(counts: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(counts, np.uint8 if len(counts) == n else np.uint32).astype(np.uint32)


def _answer(segments: int):
    """A segment's answers: the levels of what each pack has sent, in its order, and the exact counts of the words."""
    def work(table: pa.Table) -> pa.Table:
        segment, found, sizes = table["segment"][0].as_py(), {}, {}
        for kind in ("word", "pair"):
            # keys are views of the Arrow buffers; counts stay 32 bits wide until they are added
            sent = [np.frombuffer(k.as_buffer(), np.uint64) for k in table[f"{kind}s"]]
            numbers = [_widen(c.as_buffer(), len(k)) for k, c in zip(sent, table[f"{kind}_counts"], strict=True)]
            sizes[kind] = np.concatenate(([0], np.cumsum([len(k) for k in sent])))
            found[kind] = (*_count(list(zip(sent, numbers, strict=True))), sent)
            del numbers
        grams = [(keys[counts > 0], counts[counts > 0]) for keys, counts, _ in found.values()]
        bits = build_filter([(keys, levels_of(counts)) for keys, counts in grams])
        known = Model(segments, {segment: (*grams[0], bits)})
        answers = {}
        for kind, (keys, counts, sent) in found.items():
            at = np.searchsorted(keys, np.concatenate(sent))
            answers[f"{kind}_levels"] = _cut_up(known.level(keys)[at], sizes[kind])
            if kind == "word":
                answers["word_counts"] = _cut_up(known.word_count(keys)[at], sizes[kind])
        rest = [0] * (table.num_rows - 1)
        return pa.table({
            "segment": table["segment"], "pack": table["pack"], "n_tokens": pa.array([int(grams[0][1].sum()), *rest], pa.int64()),
            "n_words": pa.array([len(grams[0][0]), *rest], pa.int64()), **{name: answers[name] for name in ("word_levels", "word_counts", "pair_levels")}})

    return work


def _places(keys: np.ndarray, level: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of an entry (key, level): its word in the filter, counted from the segment's first, and the bits in it."""
    h = common.mix(keys + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    place = ((h >> np.uint64(32)) * words) >> np.uint64(32)
    mask = np.zeros(len(h), np.uint64)
    for k in range(BITS_SET):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return place.astype(np.int64), mask


def build_filter(grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The filter's 64-bit words for (keys, levels): each key is entered once per level up to its own."""
    entries = sum(int(level.sum()) for _, level in grams)
    bits = np.zeros(max(1, -(-entries * BITS_PER_ENTRY // 64)), np.uint64)
    for keys, level in grams:
        for j in range(1, int(level.max(initial=0)) + 1):
            place, mask = _places(keys[level >= j], j, np.uint64(len(bits)))
            order = np.argsort(place)
            place, mask = place[order], mask[order]
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            bits[place[first]] |= np.bitwise_or.reduceat(mask, first)
    return bits


class Model:
    """Some segments of the model: exact word counts and the filter."""

    def __init__(self, segments: int, parts: dict):
        self.segments, self.parts = segments, parts

    def _by_segment(self, keys: np.ndarray):
        order, cuts = _by_segment(keys, self.segments)
        for segment, part in self.parts.items():
            low, high = cuts[segment:segment + 2]
            if low < high:
                yield order[low:high], part

    def word_count(self, keys: np.ndarray) -> np.ndarray:
        """Exact counts of words of these segments; 0 for others."""
        out = np.zeros(len(keys), np.int64)
        for rows, (words, counts, _) in self._by_segment(keys):
            if len(words):
                at = np.minimum(np.searchsorted(words, keys[rows]), len(words) - 1)
                out[rows] = np.where(words[at] == keys[rows], counts[at], 0)
        return out

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Levels by repeated membership probes, one level at a time until one is missing; 0 for other segments' keys."""
        out = np.zeros(len(keys), np.uint8)
        for rows, (_, _, bits) in self._by_segment(keys):
            own = keys[rows]
            for j in range(1, LEVELS + 1):
                place, mask = _places(own, j, np.uint64(len(bits)))
                held = (bits[place] & mask) == mask
                rows, own = rows[held], own[held]
                if not len(rows):
                    break
                out[rows] = j
        return out


def answers_of(packs: DataFrame, segments: int) -> DataFrame:
    """One row per pack and segment: the segment's answers to the pack, and once per segment its tokens and words."""
    sent = packs.select("pack", "doc_ids", "held_out", "lengths", "words", "tokens").mapInArrow(_sender(segments), _SENT)
    return sent.groupBy("segment").applyInArrow(_answer(segments), _ANSWER)


def _reader(segments: int, n_all: int, n_distinct: int):
    """What the answers say of every text of a pack: base score, known words, levels of words and pairs."""
    scale = np.log10(n_all + n_distinct + 1)

    def work(packs: pa.Table, answers: pa.Table) -> pa.Table:
        pack = Pack(packs, 0)
        answers = answers.sort_by("segment")

        def read(name: str, kind: type, keys: np.ndarray) -> np.ndarray:
            order, _ = _by_segment(keys, segments)
            out = np.empty(len(keys), kind)
            out[order] = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in answers[name]])
            return out

        counts = read("word_counts", np.int64, pack.words)
        lengths = pack.lengths
        begin = np.cumsum(lengths) - lengths
        base = np.add.reduceat(np.log10(counts + 1.0)[pack.word_at], begin) - lengths * scale
        seen = np.add.reduceat((counts > 0).astype(np.int64)[pack.word_at], begin)
        # each text's levels: those of its words, then those of its pairs
        levels = np.empty(2 * len(pack.word_at), np.uint8)
        at = np.arange(len(pack.word_at)) + np.repeat(begin, lengths)
        levels[at] = read("word_levels", np.uint8, pack.words)[pack.word_at]
        levels[at + np.repeat(lengths, lengths)] = read("pair_levels", np.uint8, pack.pairs)[pack.pair_at]
        return pa.table({
            "doc_id": pack.ids, "held_out": pack.held_out, "n_tokens": pa.array(lengths), "n_known": pa.array(seen), "base": pa.array(base),
            "levels": _cut_up(levels, 2 * np.append(begin, begin[-1] + lengths[-1]))})

    return work


class Mixture:
    """Probabilities from levels; ``less`` occurrences of each pair are left out of the counts."""

    def __init__(self, n_texts: int, n_all: int, n_distinct: int):
        self.start = int(levels_of(np.array([n_texts]))[0])
        self.total = n_all + n_distinct + 1.0

    def parts(self, levels: bytes, less: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(level of the word before, relative frequency of the pair, smoothed frequency of the word) per token."""
        one, two = np.frombuffer(levels, np.uint8).reshape(2, -1)
        before = np.empty_like(one)
        before[1:], before[0] = one[:-1], self.start
        around = np.maximum(_VALUE[before], _VALUE[np.minimum(two, before)]) - less
        pair = np.minimum(np.maximum(_VALUE[two] - less, 0), np.maximum(around, 0))
        return before, np.where(around > 0, pair / np.maximum(around, 1e-9), 0.0), (np.maximum(_VALUE[one] - less, 0) + 1) / self.total


#: Bins of ln(pair frequency / word frequency) for the fit; the first one holds unseen pairs.
_BINS = np.concatenate(([-np.inf], np.arange(-6, 26, 0.25)))


def fit_weights(probed: DataFrame, mixture: Mixture, rounds: int = 30) -> np.ndarray:
    """The pair's weight by level of the word before: expectation maximisation on a histogram over all training texts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((LEVELS + 1) * len(_BINS), np.int64)
        for batch in batches:
            for levels in batch.column("levels").to_pylist():
                before, pair, word = mixture.parts(levels, 1)
                with np.errstate(divide="ignore"):
                    cell = np.searchsorted(_BINS, np.log(pair / word), side="right") - 1
                sums += np.bincount(before.astype(np.int64) * len(_BINS) + cell, minlength=len(sums))
        rows = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(sums[rows])], names=["cell", "n"])

    cells = probed.where("not held_out").select("levels").mapInArrow(work, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros((LEVELS + 1, len(_BINS)))
    for r in cells:
        seen[divmod(r.cell, len(_BINS))] = r.n
    ratio = np.concatenate(([0.0], np.exp(_BINS[1:] + 0.125)))[None, :]
    weight = np.full((LEVELS + 1, 1), 0.3)
    total = np.maximum(seen.sum(axis=1, keepdims=True), 1)
    for _ in range(rounds):
        weight = (seen * weight * ratio / (weight * ratio + 1 - weight)).sum(axis=1, keepdims=True) / total
        weight = np.clip(weight, 1e-4, 0.99)
    weight[0] = 0.0
    return weight[:, 0]


def score_texts(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = docs.select("doc_id", (common.fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    held, length = F.col("held_out"), F.octet_length("text")
    size = texts.agg(F.sum(length).alias("all"), F.sum(F.when(~held, length)).alias("bytes"), F.count_if(~held).alias("n")).first()
    # training texts set the segments; only where others have several times their bytes, there are more
    segments = max(1, -(-(size["bytes"] or 0) // segment_bytes), -(-(size["all"] or 0) // (4 * segment_bytes)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = texts.mapInArrow(_packer(max(1, round_bytes // TOKEN_BYTES)), f"doc_ids array<{kind}>, held_out array<boolean>, lengths binary, words binary, tokens binary")
    # numbers are given before the packs are written, so they stay whatever is run again
    packs = common.cut(packed.withColumn("pack", F.monotonically_increasing_id()), "lm-packs", maxRecordsPerFile=FILE_PACKS, **_ZSTD)
    answers = common.cut(answers_of(packs, segments), "lm-answers", **_ZSTD)
    sums = answers.agg(F.sum("n_tokens").alias("n_all"), F.sum("n_words").alias("n_distinct")).first()
    n_all, n_distinct = sums.n_all or 0, sums.n_distinct or 0
    state = common.cut(packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(
        _reader(segments, n_all, n_distinct), f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, levels binary"), "lm-probed", **_ZSTD)
    mixture = Mixture(size["n"], n_all, n_distinct)
    weight = fit_weights(state, mixture)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for levels in batch.column("levels").to_pylist():
                before, pair, word = mixture.parts(levels, 0)
                out.append(float(np.log10(weight[before] * pair + (1 - weight[before]) * word).sum()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("doc_id", "held_out", "n_tokens", "n_known", "base")], pa.array(out, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = state.mapInArrow(work, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("bigint").alias("train_tokens"), "base_score", "score")
