"""Shared helpers: words of a whole Arrow text column as numpy arrays, 64-bit word fingerprints, bounded batches.

Texts are worked on as UTF-8 bytes. Lower-casing A-Z and splitting on ASCII classes are exact on bytes, because no
byte of a multi-byte character is below 0x80.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.session import scratch_path

#: Lower case of A-Z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space 0x20, 0x09-0x0D ends.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words made of a-z, 0-9 and everything beyond ASCII (after lower-casing).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Rows are worked on in runs of about this many bytes of text (one longer text makes a run of its own).
RUN_BYTES = 1 << 20


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def write_scratch(df: DataFrame, tag: str, **options) -> str:
    """Write ``df`` below the shared folder; returns the path. Re-reading it survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return path


def cut(df: DataFrame, tag: str, **options) -> DataFrame:
    """``df`` written to and read from the shared folder."""
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df, tag, **options))


def runs(batches: Iterator[pa.RecordBatch], column: str, size: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes in ``column``, so that work arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets_of(batch.column(column))[1:].astype(np.int64)
        first = 0
        base = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(first, last - first)
            first, base = last, int(ends[last - 1])


def offsets_of(column: pa.Array) -> np.ndarray:
    """Byte offsets of a text column, starting at 0; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1]
    return raw - raw[0]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased bytes of all texts, offsets); nulls are empty."""
    data, offsets = raw_bytes_of(column)
    return LOWER[data], offsets


def raw_bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[raw[0]:raw[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, raw - raw[0]


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, words before each text and in all) of the words; no word crosses a text's border."""
    inside = kind[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    table = _powers.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, RUN_BYTES * 2), base, np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if len(table) <= RUN_BYTES * 4:
            _powers[int(base)] = table
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the words: differences of one running polynomial sum, moved to position 0 and mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = sums[1:]
    np.add(data, np.uint64(1), out=terms)
    terms *= _power_table(_BASE, len(data))[:len(data)]
    np.cumsum(terms, out=terms)
    return mix((sums[ends] - sums[starts]) * _power_table(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words joined by single spaces, and where each begins in that; word i ends at begin[i + 1] - 1."""
    lengths = ends - starts
    begin = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=begin[1:])
    out = np.full(begin[-1], 0x20, np.uint8)
    source = np.arange(int(lengths.sum())) + np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(starts) else starts, lengths)
    target = np.arange(int(lengths.sum())) + np.repeat(begin[:-1] - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(starts) else starts, lengths)
    out[target] = data[source]
    return out.tobytes(), begin


def ship(spark) -> None:
    """Send this package's code to the executors once, for clusters whose workers do not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_lakeops_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(sc._temp_dir, "lakeops.zip")  # Spark's own folder for files that its driver serves
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._lakeops_shipped = True
