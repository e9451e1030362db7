"""Language ID: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL with an elastic net.

Letters are lower-cased, everything else is a space and runs of spaces are one; n-grams of one to three characters are
counted in 2^16 slots by hash. Document frequencies come from all training texts. The weights are fitted by
follow-the-regularised-leader (per-coordinate steps, L1 makes them sparse, L2 shrinks them) on at most
``TRAIN_PER_LANG`` texts per language, whole texts all of them, those with the smallest hash of id and text together. A tenth of
that sample is kept apart to fit the temperature that calibrates the probabilities.

Cases: a null text, or one without a letter, is ``und`` with score 0; null languages are not learnt from; with one
language all texts get it; without any they are ``und``; repeated rows are predicted alike; ties go to the language
that sorts first; null and repeated ids are sampled by their texts, rows equal in both once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm import common

FOLDS, HELD_OUT = 3, 1
#: Training texts per language, at most.
TRAIN_PER_LANG = 1000
SLOTS = 1 << 16
ORDERS = 3
UNKNOWN = "und"

_fold: list[np.ndarray] = []


def letters_of(text: str) -> np.ndarray:
    """Code points: small letters, one space for anything between them, a space at both ends; empty without a letter."""
    if not _fold:
        # per code point of the basic plane: its small letter, or a space
        _fold.append(np.array([ord(low) if (c := chr(k)).isalpha() and len(low := c.lower()) == 1 else k if c.isalpha() else 32 for k in range(0x10000)], np.uint32))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = codes > 0xFFFF
    if high.any():
        other = np.array([c if chr(c).isalpha() else 32 for c in codes[high].tolist()], np.uint32)
        codes = np.where(high, 0, codes)
        out = _fold[0][codes]
        out[high] = other
    else:
        out = _fold[0][codes]
    out = np.concatenate(([np.uint32(32)], out, [np.uint32(32)]))
    out = out[np.concatenate(([True], (out[1:] != 32) | (out[:-1] != 32)))]
    return out if len(out) > 1 else out[:0]


def counts_of(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of the n-grams of one to three characters."""
    code, slots, width = letters.astype(np.uint64), [], len(letters)
    rolled = np.zeros(width, np.uint64)
    for n in range(1, ORDERS + 1):
        if width < n:
            break
        rolled = rolled[:width - n + 1] * np.uint64(0x100000001B3) + code[n - 1:] + np.uint64(n)
        slots.append(((rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64))
    counts = np.bincount(np.concatenate(slots), minlength=SLOTS) if slots else np.zeros(SLOTS, np.int64)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of a text's slots, of length 1."""
    x = (1 + np.log(counts)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (slots, langs)
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        letters = letters_of(text) if text else np.zeros(0, np.uint32)
        if not len(letters) or not self.langs:
            return UNKNOWN, 0.0
        at, counts = counts_of(letters)
        p = softmax(self.logits(at, weigh(at, counts, self.idf)) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: int, slots: int = SLOTS, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias): per-coordinate FTRL-proximal over the rows (slots, values), in a fixed shuffled order."""
    z, n = np.zeros((slots + 1, langs)), np.zeros((slots + 1, langs))

    def settle(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(42)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x = rows[k]
            at, x = np.append(at, slots), np.append(x, 1.0)
            w = settle(at)
            p = softmax(x @ w)
            p[labels[k]] -= 1
            g = x[:, None] * p[None, :]
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    w = settle(np.arange(slots + 1))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the smallest log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, part = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    a, b = high - part * (high - low), low + part * (high - low)
    for _ in range(40):
        if loss(a) <= loss(b):
            high, b = b, a
            a = high - part * (high - low)
        else:
            low, a = a, b
            b = low + part * (high - low)
    return float(np.exp((low + high) / 2))


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """(texts per slot, texts) over all training texts, added up per task before the shuffle."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros(SLOTS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text and len(letters := letters_of(text)):
                    seen[counts_of(letters)[0]] += 1
                    texts += 1
        seen[SLOTS] = texts
        rows = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(seen[rows])], names=["slot", "n"])

    found = train.select("text").mapInArrow(work, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # SLOTS rows at most
    out = np.zeros(SLOTS + 1, np.int64)
    for r in found:
        out[r.slot] = r.n
    return out[:-1], int(out[-1])


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> Model:
    rows = docs.select("doc_id", "text", "lang").where((common.fold_of(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull())
    seen, texts = document_frequencies(rows)
    idf = np.log((1 + texts) / (1 + seen)) + 1
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    # hashes first (a few numbers a row), then only the chosen texts. Different hashes spread evenly, so the wanted smallest
    # ones lie below a language's share of all; one task then ranks about per_lang of them, however many rows and tasks
    # there are; there is one share a language, and the model holds far more than that of each
    hashed = rows.withColumn("order", F.xxhash64("doc_id", "text"))
    distinct = common.cut(hashed.select("lang", "order").distinct(), "language-rows")
    share = (F.lit(1.25 * per_lang + 50) / F.col("texts")).alias("share")
    shares = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("texts")).select("lang", share)
    near = distinct.join(F.broadcast(shares), "lang").where(
        F.col("order").cast("double") / F.lit(2.0 ** 64) + 0.5 < F.col("share"))
    chosen = near.select("lang", "order").withColumn("rank", rank).where(F.col("rank") <= per_lang)
    texts_of = hashed.join(F.broadcast(chosen), ["lang", "order"]).select("lang", "rank", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.runs(batches, "text"):
            at, values = [], []
            for text in batch.column("text").to_pylist():
                letters = letters_of(text) if text else np.zeros(0, np.uint32)
                slots, counts = counts_of(letters) if len(letters) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                at.append(slots.astype(np.uint16).tobytes())
                values.append(weigh(slots, counts, idf).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["lang", "rank", "at", "x"])

    def one_each(found):
        return found.dropDuplicates(["lang", "rank"])

    sample = sorted(one_each(texts_of.mapInArrow(work, "lang string, rank int, at binary, x binary")).where(F.length("x") > 0).collect())
    langs = sorted({r.lang for r in sample})
    known = [(np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r.x, np.float32).astype(np.float64)) for r in sample]
    labels = np.array([langs.index(r.lang) for r in sample], np.int64)
    apart = np.array([r.rank % 10 == 5 for r in sample], bool)
    if len(langs) < 2:
        return Model(langs, idf, np.zeros((SLOTS, len(langs))), np.zeros(len(langs)), 1.0)
    weights, bias = ftrl([k for k, a in zip(known, apart, strict=True) if not a], labels[~apart], len(langs))
    model = Model(langs, idf, weights, bias, 1.0)
    logits = np.array([model.logits(*k) for k, a in zip(known, apart, strict=True) if a]).reshape(-1, len(langs))
    model.temperature = calibrate(logits, labels[apart])
    return model


def report(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """One row per document: held_out, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, per_lang))  # SLOTS x languages numbers
    texts = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.runs(batches, "text"):
            found = [model.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    scored = texts.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return scored.select("doc_id", (common.fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
